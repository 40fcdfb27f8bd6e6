"""Operator 5: toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document, so tokens are labelled from them: a word of a toxic training document is a toxic token if
one of its features (itself, its first 3, 4 or 5 bytes) stands in far more toxic training documents than clean ones. The field
has the tags clean and toxic, weights for these features and for transitions, and is trained on windows of a bounded
sample of labelled rows (``TOXIC_ROWS`` and ``CLEAN_ROWS``, by hash order). Scoring takes every word of every text:
forward-backward runs over words with known features, and the runs of other words between them, all of which weigh
alike, are passed by powers of one matrix. A logistic curve over the marginals' largest value and sum gives the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.session import importable
from glossweave.llm import exchange as X
from glossweave.llm import text as T
from glossweave.llm.license_scan import find

#: Labelled rows that the field is fitted on at most, of either kind.
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
#: Bytes of word beginnings that are features.
PREFIXES = (3, 4, 5)
#: A feature is kept if it stands in this many toxic documents and its log-odds reach LIFT.
SEEN, LIFT = 3, 3.0
#: Words of a training window, and windows at most.
WINDOW, WINDOWS = 24, 12_000
THRESHOLD = 0.3


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(starts, ends, first words, features): feature hashes of each word, one array for each kind."""
    low = T.LOWER[data]
    s, e, first = T.words(low, offs, T.ALNUM)
    kinds = [T.word_hashes(low, s, e)]
    for n in PREFIXES:
        h = T.mix(T.word_hashes(low, s, np.minimum(e, s + n)) + np.uint64(n))
        h[e - s < n] = 0
        kinds.append(h)
    return s, e, first, kinds


def batched_marginals(emit: np.ndarray, step: np.ndarray, start: np.ndarray, last: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, pair marginals) of chains [chain, position, tag], all in one pass each way, scaled at every position.

    step[:, i] leads from position i-1 to i (step[:, 0] is not used), start is the weight before position 0, and tail
    the weight after position ``last`` of each chain."""
    n, length, _ = emit.shape
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    a = start * emit[:, 0]
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, length):
        a = np.einsum("nj,njk->nk", alpha[:, i - 1], step[:, i]) * emit[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    b = np.ones((n, 2))
    for i in range(length - 1, -1, -1):
        if i < length - 1:
            b = np.einsum("njk,nk->nj", step[:, i + 1], emit[:, i + 1] * b)
        end = last == i
        b[end] = tail[end]
        b = b / b.sum(axis=1, keepdims=True)
        beta[:, i] = b
    m = alpha * beta
    m /= m.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * step[:, 1:] * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
    return m, pair


class Field:
    """The fitted chain, and the curve from its marginals to a document's score."""

    def __init__(self, prior: float):
        self.prior = prior
        self.table = np.zeros(0, np.uint64)  # feature hashes, sorted
        self.weight = np.zeros(0)
        self.bias, self.trans = -5.0, np.zeros((2, 2))
        self.curve = None

    def known(self, kinds: list[np.ndarray]) -> np.ndarray:
        """Feature numbers [kind, word], -1 where unknown."""
        return np.stack([find(h, self.table) for h in kinds])

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.bias + np.where(features >= 0, self.weight[features] if len(self.weight) else 0, 0).sum(axis=0)

    def fit(self, texts: list[str], toxic: np.ndarray, odds: float, rounds: int = 60) -> None:
        """odds: how much more a clean row of the sample stands for than a toxic one."""
        col = pa.array(texts, pa.large_string())
        n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
        # documents of either kind that have a feature, counted slice by slice
        totals: list[dict[int, np.ndarray]] = []
        for k in range(1 + len(PREFIXES)):
            seen = [(u, n) for i, _, d, o in T.texts(col) for u, n in [_documents(d, o, k, toxic[i:])]]
            u, inverse = np.unique(np.concatenate([u for u, _ in seen]), return_inverse=True)
            counts = np.stack([np.bincount(inverse, weights=np.concatenate([n[:, c] for _, n in seen]), minlength=len(u)) for c in (0, 1)], axis=1)
            lift = np.log((counts[:, 1] + 0.5) / (n1 + 1)) - np.log((counts[:, 0] + 0.5) / (n0 + 1))
            totals.append(u[(counts[:, 1] >= SEEN) & (lift >= LIFT) & (u != 0)])
        self.table = np.unique(np.concatenate(totals))
        self.weight = np.zeros(len(self.table))
        if not len(self.table):
            return
        # windows with known features, and as many others, spread over the sample
        rng = np.random.default_rng(5)
        hot, cold = [], []
        for i, _, d, o in T.texts(col):
            first, features = (x := tokens(d, o))[2], self.known(x[3])
            doc = np.repeat(np.arange(len(o) - 1), np.diff(first))
            heads = np.flatnonzero((np.arange(len(doc)) - first[doc]) % WINDOW == 0)
            size = np.diff(np.append(heads, len(doc)))
            some = np.add.reduceat((features >= 0).any(axis=0).astype(int), heads) > 0 if len(heads) else np.zeros(0, bool)
            for kept, want in ((hot, True), (cold, False)):
                rows = rng.permutation(np.flatnonzero(some == want))
                rows = rows if want else rows[: 1 + WINDOWS * len(d) // max(1, 2 * col.nbytes)]
                index = np.minimum(heads[rows][:, None] + np.arange(WINDOW), max(0, len(doc) - 1))
                kept.append((features[:, index].astype(np.int32), size[rows], toxic[i + doc[heads[rows]]] == 1))
        flat, size, bad = (np.concatenate([x[k] for x in hot + cold], axis=1 if k == 0 else 0) for k in range(3))
        n_hot = sum(len(x[1]) for x in hot)
        rows = np.concatenate([rng.permutation(n_hot)[: WINDOWS // 2], np.arange(n_hot, len(size))])
        flat, size, bad = flat[:, rows], size[rows], bad[rows]
        mask = np.arange(WINDOW) < size[:, None]
        gold = (flat >= 0).any(axis=0) & bad[:, None] & mask
        last = size - 1
        params = np.concatenate([np.zeros(len(self.table)), [-3.0], np.zeros(4)])
        m1, m2 = np.zeros_like(params), np.zeros_like(params)
        n = len(rows)
        both = np.stack([~gold, gold], axis=2) & mask[:, :, None]
        gold_pair = np.einsum("ntj,ntk->jk", both[:, :-1].astype(float), both[:, 1:].astype(float))
        inner = (mask[:, 1:])[:, :, None, None]
        for r in range(1, rounds + 1):
            w, b, tr = params[:-5], params[-5], params[-4:].reshape(2, 2)
            score = np.where(flat >= 0, w[flat], 0).sum(axis=0) + b
            emit = np.exp(np.stack([-score / 2, score / 2], axis=2).clip(-30, 30))
            step = np.broadcast_to(np.exp(tr), (n, WINDOW, 2, 2))
            m, pair = batched_marginals(emit, step, np.ones((n, 2)), last, np.ones((n, 2)))
            gap = (gold - m[:, :, 1]) * mask
            g = np.zeros_like(params)
            for k in range(len(flat)):
                ok = flat[k] >= 0
                g[: len(w)] += np.bincount(flat[k][ok], weights=gap[ok], minlength=len(w))
            g[-5] = gap.sum()
            g[-4:] = (gold_pair - (pair * inner).sum(axis=(0, 1))).ravel()
            g = g / n - 1e-4 * params
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            params = params + 0.3 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
        self.weight, self.bias, self.trans = params[:-5], params[-5], params[-4:].reshape(2, 2)
        x = np.zeros((len(texts), 2))
        for i, j, d, o in T.texts(col):
            x[i:j] = self.summaries(d, o)[0]
        self.curve = _logistic(x, toxic.astype(float), np.where(toxic == 1, 1.0, odds), ridge=1.0)

    def summaries(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(what the curve takes of each text; text, start byte, end byte, marginal of each word with known features)."""
        n = len(offs) - 1
        out = np.zeros((n, 2))
        s, e, first, kinds = tokens(data, offs)
        features = self.known(kinds)
        at = np.flatnonzero((features >= 0).any(axis=0))
        none = np.zeros(0, np.int64)
        if not len(at):
            return out, none, none, none, np.zeros(0)
        doc = np.searchsorted(first, at, "right") - 1
        score = self.emissions(features[:, at])
        n_words, pos = np.diff(first), at - first[doc]
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        size = np.diff(np.append(begin, len(at)))
        gap = np.diff(pos, prepend=0) - 1
        gap[begin] = pos[begin]
        marginal = np.zeros(len(at))
        plain = np.exp(self.trans) * np.exp(np.array([-self.bias / 2, self.bias / 2]))[None, :]
        before_first = np.exp(np.array([-self.bias / 2, self.bias / 2]))
        hop = np.exp(self.trans)
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):  # chains of like length together, within a bounded number of cells
            j = i + 1
            while j < len(order) and size[order[j]] * (j - i + 1) <= 200_000:
                j += 1
            rows = order[i:j]
            width = int(size[rows].max())
            cell = np.minimum(begin[rows][:, None] + np.arange(width), len(at) - 1)
            sc = np.where(np.arange(width) < size[rows][:, None], score[cell], 0.0).clip(-60, 60)
            emit = np.exp(np.stack([-sc / 2, sc / 2], axis=2))
            step = run_powers(plain, gap[cell]) @ hop
            k0 = pos[begin[rows]]
            start = np.ones((len(rows), 2))
            some = k0 > 0
            if some.any():
                v = np.einsum("j,njk->nk", before_first, run_powers(plain, np.maximum(k0 - 1, 0)))
                start[some] = (v @ hop)[some]
            after = n_words[doc[begin[rows]]] - pos[begin[rows] + size[rows] - 1] - 1
            tail = run_powers(plain, after).sum(axis=2)
            m, _ = batched_marginals(emit, step, start, size[rows] - 1, tail)
            inside = np.arange(width) < size[rows][:, None]
            marginal[cell[inside]] = m[:, :, 1][inside]
            i = j
        top = np.zeros(n)
        np.maximum.at(top, doc, marginal)
        out[:, 0] = np.log((top + 1e-4) / (1 - top + 1e-4)) - np.log(1e-4)
        out[:, 1] = np.log1p(np.bincount(doc, weights=marginal, minlength=n))
        out[top == 0] = 0
        return out, doc, s[at], e[at], marginal

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-(x @ self.curve[:-1] + self.curve[-1]).clip(-30, 30)))


def _documents(data: np.ndarray, offs: np.ndarray, kind: int, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of one kind, how many clean and toxic documents have each) in a slice."""
    _, _, first, kinds = tokens(data, offs)
    h, doc = _pairs(kinds[kind], np.repeat(np.arange(len(offs) - 1), np.diff(first)))
    u, inverse = np.unique(h, return_inverse=True)
    bad = np.bincount(inverse, weights=toxic[doc], minlength=len(u))
    return u, np.stack([np.bincount(inverse, minlength=len(u)) - bad, bad], axis=1)


def _pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, document)."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def run_powers(m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """m**k, each up to a positive factor, for an array of exponents, by squaring."""
    out = np.broadcast_to(np.eye(2), (*k.shape, 2, 2)).copy()
    p, left = m / m.sum(), k.copy()
    while left.any():
        odd = left & 1 == 1
        out[odd] = out[odd] @ p
        out[odd] /= out[odd].sum(axis=(1, 2), keepdims=True)
        p = p @ p
        p = p / p.sum()
        left >>= 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last coefficient is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
        g = a.T @ (weight * (y - p)) - penalty @ w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-6 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w = w + d * min(1.0, 5.0 / max(1e-9, np.abs(d).max()))
        if np.abs(d).max() < 1e-7:
            break
    return w


def fold(mod: int):
    """crc32 of doc_id as text, modulo ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, out: int = 2, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Field:
    """Fit on labelled rows outside the fold; a document with contrary labels counts as toxic."""
    importable(docs.sparkSession)
    seen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(mod) != out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    field = Field(n1 / (n1 + n0) if n1 else 0.0)
    if not n1 or not n0:
        return field
    by_hash = [seen.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, toxic_rows), (0, clean_rows))]
    sample = by_hash[0].union(by_hash[1])  # at most toxic_rows + clean_rows ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow()
    y = rows["toxic"].to_numpy().astype(np.int64)
    if len(y) and 0 < y.sum() < len(y):
        field.fit([t or "" for t in rows["text"].to_pylist()], y, (n0 / min(n0, clean_rows)) / (n1 / min(n1, toxic_rows)))
    return field


def score(docs: DataFrame, field: Field, mod: int = 4, out: int = 2, threshold: float = THRESHOLD, spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted[, spans] of every document.

    ``docs`` has doc_id and text; other columns are left out. spans are (start byte, end byte, marginal) of words whose
    marginal is at least one half. Null and empty texts score as texts without known words; repeated rows give a row
    each; no rows give no rows. A field without labels of both kinds gives the share of toxic labels (0 without any).
    """
    importable(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def rows(batches):
        X.trim()
        for b in batches:
            for i, j, data, offs in T.texts(b.column(2)):
                x, doc, s, e, m = field.summaries(data, offs)
                p = field.scores(x)
                cols = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                names = ["doc_id", "held_out", "score", "predicted"]
                if spans:
                    keep = m >= 0.5
                    d = doc[keep]
                    at = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=j - i))]).astype(np.int32)
                    flat = pa.StructArray.from_arrays([pa.array(s[keep] - offs[d]), pa.array(e[keep] - offs[d]), pa.array(m[keep])], ["start", "end", "marginal"])
                    cols.append(pa.ListArray.from_arrays(pa.array(at), flat).cast(pair))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, held_out boolean, score double, predicted int" + ", spans array<struct<start:long,end:long,marginal:double>>" * spans
    return docs.select("doc_id", (fold(mod) == out).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)
