"""Operator 6: document quality by a hierarchical empirical Bayes over hosts and paths.

A logistic classifier over text measures, fitted on a bounded sample of labelled rows, gives each document its evidence.
Grouped sums of that evidence over all documents give a posterior of good quality to each host and, below it, to each path:
a site's mean is shrunk to its parent's (a path to its host, a host to the whole) with the strength that the spread
between sites calls for (method of moments), so sparse sites stay near the prior. A document's score joins its own
evidence with its path's posterior, from which its own share is taken out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossweave.functions.session import importable, stored
from glossweave.llm import exchange as X
from glossweave.llm import text as T
from glossweave.llm.toxicity import _logistic

#: Labelled rows that the classifier is fitted on at most, by hash order.
TRAIN_ROWS = 20_000
#: Documents scoring lower are rejected.
THRESHOLD = 0.5
#: Bounds of the number of pseudo-documents that a prior weighs, and how much a site's log-odds count.
LEAST, MOST, SITE_WEIGHT = 2.0, 1000.0, 0.5
SALTS = 16

_CLASSES = {name: np.isin(np.arange(256), list(chars.encode())) for name, chars in {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:?", "shout": "!", "bar": "|", "symbol": "#$%&*@^~=+<>\\/_", "bracket": "()[]{}", "space": " \t", "line": "\n"}.items()}
_CLASSES["high"] = np.arange(256) >= 128
MEASURES = [*_CLASSES, "log_bytes", "log_words", "word_bytes", "repeated", "distinct", "line_words", "triples"]


def measures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of text measures for each text."""
    n = len(offs) - 1
    size = np.maximum(1, np.diff(offs))
    out = np.zeros((n, len(MEASURES)))
    for k, mask in enumerate(_CLASSES.values()):
        c = np.concatenate([[0], np.cumsum(mask[data])])
        out[:, k] = (c[offs[1:]] - c[offs[:-1]]) / size
    low = T.LOWER[data]
    s, e, first = T.words(low, offs, T.SOLID)
    n_words = np.diff(first)
    some = np.maximum(1, n_words)
    h = T.word_hashes(low, s, e)
    doc = np.repeat(np.arange(n), n_words)
    lines = out[:, list(_CLASSES).index("line")] * size + 1

    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    inside = np.flatnonzero(doc[: max(0, len(h) - 2)] == doc[2:])  # triples within one text
    out[:, len(_CLASSES) :] = np.stack(
        [np.log1p(np.diff(offs)), np.log1p(n_words), np.bincount(doc, weights=e - s, minlength=n) / some, np.bincount(doc, weights=same, minlength=n) / some, _distinct(h, doc, n) / some, n_words / lines, _distinct(T.ngrams(h, 3)[inside], doc[inside], n) / some], axis=1
    )
    return out


def _distinct(x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different values each text has."""
    if not len(x):
        return np.zeros(n)
    order = np.lexsort((x, doc))
    x, d = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


class Classifier:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        if self.weights is None:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        return (z @ self.weights[:-1] + self.weights[-1]).clip(-20, 20)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Fitted on at most ``rows`` labelled documents; contrary labels count as bad quality."""
    importable(docs.sparkSession)
    seen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("quality", "text")

    def measure(batches):
        for b in batches:
            for i, j, data, offs in T.texts(b.column(1)):
                x = measures(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c) for c in x.T)], ["quality", *MEASURES])

    got = found.mapInArrow(measure, "quality int, " + ", ".join(f"`{m}` double" for m in MEASURES)).toArrow()
    y = got["quality"].to_numpy().astype(float)
    x = np.stack([got[m].to_numpy() for m in MEASURES], axis=1) if len(y) else np.zeros((0, len(MEASURES)))
    prior = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(x.shape[1]), np.ones(x.shape[1]), None, prior)
    order = np.lexsort(x.T)  # sums do not depend on the order in which rows came
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Classifier(mean, scale, _logistic(((x - mean) / scale).clip(-8, 8), y, np.ones(len(y)), ridge=0.5), prior)


def with_evidence(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` (any columns, and last ``text``) without its text, and the classifier's log-odds as ``evidence``."""
    kept = docs.columns[:-1]

    def rows(batches):
        X.trim()
        for b in batches:
            out = np.zeros(b.num_rows)
            for i, j, data, offs in T.texts(b.column(len(kept))):
                out[i:j] = model.evidence(measures(data, offs))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*kept, "evidence"])

    return docs.mapInArrow(rows, StructType(docs.schema.fields[:-1]).add("evidence", "double"))


def site(source: Column, lang: Column) -> tuple[Column, Column]:
    """(host, path): a URL's host and first path step; of other sources, the part before a slash and, after it, the step or else the language."""
    bare = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    step = F.split_part(bare, F.lit("/"), F.lit(2))
    return F.lower(F.split_part(bare, F.lit("/"), F.lit(1))), F.when(step != "", step).otherwise(F.coalesce(lang.cast("string"), F.lit("")))


def _strength(sums: DataFrame, mean: float | Column) -> float:
    """Pseudo-documents of the prior: m(1-m)/v - 1, with v the spread of site means beyond what chance gives them."""
    m = F.lit(mean) if isinstance(mean, float) else mean
    r = sums.where("n > 1").agg(
        F.sum("n").alias("n"), F.count("*").alias("sites"),
        F.sum(F.col("n") * F.pow(F.col("p") / F.col("n") - m, 2)).alias("between"), F.sum(F.col("pp") - F.col("p") * F.col("p") / F.col("n")).alias("within"), F.sum(F.col("n") * m * (1 - m)).alias("bound"),
    ).first()
    if not r["sites"] or r["sites"] < 2 or not r["n"]:
        return LEAST
    chance = max(0.0, r["within"]) / max(1.0, r["n"] - r["sites"])
    v = max(0.0, (r["between"] - r["sites"] * chance) / r["n"])
    return float(min(MOST, max(LEAST, (r["bound"] / r["n"]) / v - 1))) if v > 1e-12 else MOST


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, host_posterior, path_posterior, n, p), the whole's mean) from rows (host, path, evidence).

    Sums are combined before they are shuffled, so a host with many documents is no more than a row a task."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("p"), F.sum(p * p).alias("pp"))
    paths = stored(paths, "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "p", "pp")))
    whole = hosts.agg(F.sum("n"), F.sum("p")).first()
    mean = float((whole[1] or 0) + 1) / float((whole[0] or 0) + 2)
    k = _strength(hosts, mean)
    hosts = hosts.select("host", ((F.col("p") + k * mean) / (F.col("n") + k)).alias("host_posterior"))
    both = paths.join(hosts, "host")
    k = _strength(both, F.col("host_posterior"))
    return both.select("host", "path", "host_posterior", ((F.col("p") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"), "n", "p", F.lit(k).alias("strength")), mean


def _decided(rows: DataFrame, sites: DataFrame, mean: float, threshold: float) -> DataFrame:
    """``rows`` (with host, path, evidence, salt) and classifier, host_posterior, path_posterior, score, keep."""
    # a host may hold a third of all rows: its row stands under several salts
    spread = sites.select("host", "path", "host_posterior", "path_posterior", "n", "strength", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    n = F.col("n") + F.col("strength")
    rest = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), (F.col("path_posterior") * n - p) / F.greatest(F.lit(1e-9), n - 1)))
    total = F.col("evidence") + SITE_WEIGHT * (_logit(rest) - F.lit(float(np.log(mean / (1 - mean)))))
    found = rows.join(spread, ["host", "path", "salt"]).withColumn("classifier", p).withColumn("score", 1 / (1 + F.exp(-total)))
    return found.withColumn("keep", F.col("score") >= threshold)


def _evidence(docs: DataFrame, labels: DataFrame, source: str, lang: str) -> tuple[DataFrame, Classifier]:
    model = train(docs, labels)
    host, path = site(F.col(source), F.col(lang))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    slim = docs.select("doc_id", host.alias("host"), path.alias("path"), salt.alias("salt"), F.col("text").cast("string").alias("text"))
    return stored(with_evidence(slim, model), "evidence"), model


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, host, path, classifier, host_posterior, path_posterior, score, keep of every document; texts are measured once.

    ``docs`` has doc_id, text, and the columns named for source and language. Null and empty texts are measured as empty
    texts, null sources and languages are sites named by the empty text, repeated rows count as often as they stand, and no
    rows give no rows. Without labels of both kinds the evidence is the labels' share (one half without any), and without
    documents the sites' means are one half. A document is kept if its score is at least ``threshold``.
    """
    found, _ = _evidence(docs, labels, source, lang)
    sites, mean = posteriors(found.select("host", "path", "evidence"))
    return _decided(found, sites, mean, threshold).select("doc_id", "host", "path", "classifier", "host_posterior", "path_posterior", "score", "keep")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, source: str = "source", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, whatever their other columns are called, that ``scores`` keeps.

    Texts are measured again here, as the alternative is to move them to their scores."""
    found, model = _evidence(docs, labels, source, lang)
    sites, mean = posteriors(found.select("host", "path", "evidence"))
    host, path = site(F.col(source), F.col(lang))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), host.alias("host"), path.alias("path"), salt.alias("salt"), F.col("text").cast("string").alias("text"))
    return _decided(with_evidence(whole, model), sites, mean, threshold).where("keep").select("row.*")
