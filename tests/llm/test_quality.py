import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glossweave.functions.session import table
from glossweave.llm import quality as Q
from glossweave.llm import text as T


def test_measures_against_plain_python():
    texts = ["The The cat, sat!\nOn | it", "", "a b a b a b", "É É 12 ##"]
    data, offs = T.utf8(pa.array(texts))
    got = Q.measures(data, offs)
    at = {m: k for k, m in enumerate(Q.MEASURES)}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        n = max(1, len(w))
        assert np.isclose(got[i, at["repeated"]], sum(a == b for a, b in zip(w, w[1:], strict=False)) / n)
        assert np.isclose(got[i, at["distinct"]], len(set(w)) / n)
        assert np.isclose(got[i, at["triples"]], len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) / n)
        assert np.isclose(got[i, at["upper"]], sum(c.isupper() and c.isascii() for c in t) / max(1, len(t.encode())))


def test_posteriors_against_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = [(h, p, float(x)) for h, p, n in (("a", "x", 40), ("a", "y", 3), ("b", "x", 1), ("c", "", 25)) for x in rng.normal(h == "a", 1, n)]
    sites, mean = Q.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    p = [1 / (1 + np.exp(-r[2])) for r in rows]
    assert np.isclose(mean, (sum(p) + 1) / (len(p) + 2))
    got = {(r["host"], r["path"]): r for r in sites.collect()}
    for (h, x), r in got.items():
        own = [q for q, row in zip(p, rows, strict=True) if row[:2] == (h, x)]
        assert r["n"] == len(own) and np.isclose(r["p"], sum(own))
        assert np.isclose(r["path_posterior"], (sum(own) + r["strength"] * r["host_posterior"]) / (len(own) + r["strength"]))
        lo, hi = sorted((np.mean(own), r["host_posterior"]))
        assert lo - 1e-9 <= r["path_posterior"] <= hi + 1e-9
    few = got["b", "x"]  # one document hardly moves its site
    assert abs(few["host_posterior"] - mean) < abs(p[43] - mean)


def plain_strength(sums, means):
    """sums: site -> probabilities; means: site -> the prior's mean."""
    many = [k for k, p in sums.items() if len(p) > 1]
    n = sum(len(sums[k]) for k in many)
    if len(many) < 2:
        return Q.LEAST
    between = sum(len(sums[k]) * (np.mean(sums[k]) - means[k]) ** 2 for k in many)
    within = sum(sum((np.array(sums[k]) - np.mean(sums[k])) ** 2) for k in many)
    bound = sum(len(sums[k]) * means[k] * (1 - means[k]) for k in many)
    v = max(0.0, (between - len(many) * within / max(1, n - len(many))) / n)
    return min(Q.MOST, max(Q.LEAST, bound / n / v - 1)) if v > 1e-12 else Q.MOST


def plain_scores(rows, model):
    """rows: (doc_id, text, source, lang)."""
    data, offs = T.utf8(pa.array([r[1] for r in rows], pa.string()))
    evidence = model.evidence(Q.measures(data, offs))
    p = 1 / (1 + np.exp(-evidence))
    sites = []
    for _, _, source, lang in rows:
        bare = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", source or "").split("/")
        sites.append((bare[0].lower(), bare[1] if len(bare) > 1 and bare[1] else lang or ""))
    paths, hosts = {}, {}
    for s, x in zip(sites, p, strict=True):
        paths.setdefault(s, []).append(x)
        hosts.setdefault(s[0], []).append(x)
    mean = (p.sum() + 1) / (len(p) + 2)
    k = plain_strength(hosts, dict.fromkeys(hosts, mean))
    host = {h: (sum(x) + k * mean) / (len(x) + k) for h, x in hosts.items()}
    k = plain_strength(paths, {s: host[s[0]] for s in paths})
    path = {s: (sum(x) + k * host[s[0]]) / (len(x) + k) for s, x in paths.items()}
    out = []
    for (i, *_), s, e, x in zip(rows, sites, evidence, p, strict=True):
        n = len(paths[s]) + k
        rest = min(1 - 1e-4, max(1e-4, (path[s] * n - x) / max(1e-9, n - 1)))
        total = e + Q.SITE_WEIGHT * (np.log(rest / (1 - rest)) - np.log(mean / (1 - mean)))
        out.append((i, *s, x, host[s[0]], path[s], 1 / (1 + np.exp(-total))))
    return out


def test_scores_against_plain_python(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://Host"), F.col("doc_id") % 5, F.lit(".org/p"), F.col("doc_id") % 2, F.lit("/x"))).otherwise(F.col("source")))
    want = sorted(plain_scores([tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()], Q.train(docs, labels)))
    got = sorted(tuple(r) for r in Q.scores(docs, labels).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3:7] for x in got], [x[3:] for x in want], rtol=1e-6)
    assert all(x[7] == (x[6] >= Q.THRESHOLD) for x in got)
    assert sorted(r[0] for r in Q.kept(docs, labels).collect()) == [x[0] for x in got if x[7]]


def test_names_of_other_columns_do_not_matter(spark, sf):
    docs = table(spark, sf, "documents").limit(50)
    more = docs.selectExpr("*", "1 as host", "2 as evidence", "3 as salt", "4 as keep", "5 as __salt", "6 as row", "7 as `n.1`")
    got = Q.kept(more, table(spark, sf, "labels"))
    assert got.columns == more.columns and {tuple(r)[5:] for r in got.collect()} == {(1, 2, 3, 4, 5, 6, 7)}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    found = Q.scores(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    r = found.selectExpr("count_if(not keep and quality = 0) hit", "count_if(not keep and quality = 1) wrong", "count_if(quality = 0) bad", "count_if(quality = 1) good").first()
    assert r["hit"] / r["bad"] > 0.95 and r["wrong"] / r["good"] < 0.02


def test_odd_rows(spark, odd, docs_of):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (None, 1, 1), (4, None, 1), (5, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        got = Q.scores(odd.union(odd), l).collect()
        assert len(got) == 20 and all(0 <= r["score"] <= 1 for r in got)
        assert Q.kept(odd.union(odd), l).count() == sum(r["keep"] for r in got)
    assert Q.scores(docs_of([]), labels).count() == Q.kept(docs_of([]), labels).count() == 0
