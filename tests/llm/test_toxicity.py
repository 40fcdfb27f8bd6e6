import itertools

import numpy as np
import pyarrow as pa

from glossweave.functions.session import table
from glossweave.llm import text as T
from glossweave.llm import toxicity as X


def test_marginals_against_enumeration():
    f = X.Field(0.1)
    f.bias, f.trans = -1.3, np.array([[0.4, -0.3], [-0.2, 0.1]])
    f.table = np.unique(np.array([T.hash_of("bad"), T.hash_of("ugly")], np.uint64))
    f.weight = np.array([2.0, 3.0])
    texts = ["bad a b c ugly d", "a b bad", "ugly", "x bad bad y z", "a b c", ""]
    data, offs = T.utf8(pa.array(texts))
    _, doc, s, e, m = f.summaries(data, offs)
    got = {(d, bytes(data[a:b]).decode(), int(a - offs[d])): x for d, a, b, x in zip(doc, s, e, m, strict=True)}
    for d, t in enumerate(texts):
        words = t.split()
        sc = [f.bias + (f.weight[f.table.tolist().index(T.hash_of(w))] if w in ("bad", "ugly") else 0) for w in words]
        z, on = 0.0, np.zeros(len(words))
        for tags in itertools.product((0, 1), repeat=len(words)):
            p = np.exp(sum(x / 2 if y else -x / 2 for x, y in zip(sc, tags, strict=True)) + sum(f.trans[a, b] for a, b in itertools.pairwise(tags)))
            z += p
            on += p * np.array(tags)
        for k, w in enumerate(words):
            if w in ("bad", "ugly"):
                at = len(" ".join(words[:k])) + (k > 0)
                assert abs(got.pop((d, w, at)) - on[k] / z) < 1e-9
    assert not got


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = X.score(docs, X.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.predicted == 1).sum() > 0.9 and hit / (got.toxic == 1).sum() > 0.9
    assert got.score.between(0, 1).all()


def test_odd_rows(spark, odd, docs_of):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (None, 1, 1), (4, 1, None), (5, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        f = X.train(odd, l)
        got = X.score(odd.union(odd), f).collect()
        assert len(got) == 20 and all(0 <= r["score"] <= 1 for r in got)
    assert X.score(docs_of([]), f).count() == 0
