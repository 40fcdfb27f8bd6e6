import hashlib
import re

import numpy as np

from glossweave.functions.session import table
from glossweave.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = {}
    sizes = {len(w) for w in windows}
    for i, t in docs:
        w = WORD.findall(low(t))
        hit, own = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                x = windows.get(tuple(w[k : k + n]))
                if x:
                    own |= x
                    hit |= set(range(k, k + n))
        out.setdefault(i, []).append((len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def check(spark, docs, bench, **kw):
    got = {}
    for r in D.digest(D.scan(docs, bench, **kw)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]))
    want = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], [(r[0], r[1]) for r in bench.select("item_id", "text").collect()])
    assert got == want


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 400):
        seq = rng.integers(0, 4, n)
        seq[n // 2 :] = 2
        text = np.append(seq + 1, 0)
        assert D.suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        ix = D.FMIndex(seq, 3)
        for m in (1, 2, 5):
            pat = rng.integers(1, 4, (30, m))
            lo, hi = ix.search(pat, np.full(30, m))
            for p, a, z in zip(pat, lo, hi, strict=True):
                want = [i for i in range(n - m + 1) if seq[i : i + m].tolist() == p.tolist()]
                assert sorted(ix.locate(np.arange(a, z)).tolist()) == want


def test_against_brute_force(spark, sf):
    check(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def test_words_that_only_share_a_hash(spark, docs_of, monkeypatch):
    import pyarrow as pa

    from glossweave.llm import text as T

    p = D.Phrases([(1, "red green blue"), (2, "green")], 10)
    data, offs = T.utf8(pa.array(["red green blue", "red GREEN grey", "green"]))
    s, e, first = T.words(T.LOWER[data], offs, T.ALNUM)
    h = T.word_hashes(T.LOWER[data], s, e)
    h[5] = T.hash_of("blue")  # as if grey had the hash of blue
    which, at = D.occurrences(p, h, np.repeat(np.arange(3), np.diff(first)), data, s, e)
    assert sorted((int(p.lengths[w]), int(a)) for w, a in zip(which, at, strict=True)) == [(1, 1), (1, 4), (1, 6), (3, 0)]
    from test_packing import twins

    a, b = twins(1024)
    check(spark, docs_of([(1, a), (2, f"x {b} {a}")]), spark.createDataFrame([(1, b)], "item_id long, text string"))


def test_names_of_other_columns_do_not_matter(spark, docs_of):
    docs = docs_of([(1, "a b c"), (2, None)]).selectExpr("*", "7 as __hits", "8 as row", "9 as found", "10 as `odd.name`")
    bench = spark.createDataFrame([(None, "b"), (2, "z")], "item_id string, text string")
    for kw in ({}, {"block_chars": 1}):
        got = {r["doc_id"]: r for r in D.scan(docs, bench, cleaned=True, **kw).collect()}
        assert got[1]["text"] == "a  c" and got[1]["items"] == [""] and (got[2]["__hits"], got[2]["row"], got[2]["found"], got[2]["odd.name"]) == (7, 8, 9, 10)


def test_odd_rows_and_blocks(spark, odd, docs_of):
    bench = spark.createDataFrame([(1, "Same text HERE"), (2, None), (3, ""), (4, "word " * 12), (4, "word " * 12), (5, "one")], "item_id long, text string")
    docs = odd.union(odd)
    check(spark, docs, bench)
    check(spark, docs, bench, block_chars=20)
    check(spark, docs, bench.limit(0))
    assert D.scan(docs_of([]), bench).count() == 0


def test_spans_are_cut_out(spark, docs_of):
    bench = spark.createDataFrame([(1, "b c d"), (2, "d e")], "item_id long, text string")
    docs = docs_of([(1, "A, B c; d! e. f"), (2, None), (3, "b c"), (4, "ß b-c-d")])
    for kw in ({}, {"block_chars": 3}):
        got = {r["doc_id"]: r for r in D.scan(docs, bench, cleaned=True, **kw).collect()}
        assert {k: r["text"] for k, r in got.items()} == {1: "A, . f", 2: None, 3: "b c", 4: "ß "}
        assert got[1]["spans"][0].asDict() == {"first": 1, "n": 4, "start": 3, "end": 12}
        assert got[1]["rank"] == 1 and got[1]["items"] == ["1", "2"]
