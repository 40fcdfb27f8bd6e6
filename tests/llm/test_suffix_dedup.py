import hashlib
import random

import numpy as np

from glossweave.functions.session import table
from glossweave.llm import suffix_dedup as S


def brute(rows, length):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                x = b[k : k + length]
                least[x] = min(i, least.get(x, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if least[b[k : k + length]] < i:
                    gone[k : k + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(docs, length=50, **kw):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.dedup(docs, length, **kw).collect())
    assert got == brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], length)
    return sum(r[2] for r in got)


def test_suffix_sort():
    rng = np.random.default_rng(4)
    for n, letters in ((1, 3), (40, 2), (200, 3)):
        data = rng.integers(97, 97 + letters, 600).astype(np.uint8)
        start = rng.integers(0, 550, n)
        size = rng.integers(1, 50, n)
        group = np.sort(rng.integers(0, 4, n))
        rng.shuffle(group)
        order, share = S.suffix_sort(data, start, size, group)
        key = [(group[i], bytes(data[start[i] : start[i] + size[i]])) for i in order]
        assert key == sorted(key)
        for k in range(1, n):
            (g, a), (h, b) = key[k - 1], key[k]
            want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) if g == h else 0
            assert share[k] == want


def test_against_brute_force(spark, sf):
    assert check(table(spark, sf, "documents")) > 1000
    check(table(spark, sf, "documents"), hot_texts=3)


def test_misleading_hashes_change_nothing(spark, sf, docs_of):
    docs = table(spark, sf, "documents").limit(60)
    for hot in (2, S.HOT_TEXTS):
        for bits in (3, 12):
            assert check(docs.union(docs.selectExpr("doc_id + 1000", "concat('x', text)", "lang", "source", "n_chars")), hot_texts=hot, bits=bits) > 1000


def test_hot_strings_take_one_pass(monkeypatch):
    """A shard finds the anchors of its texts once, whether seeds are hot or not, and strings that one shard alone sent are not sorted."""
    rng = random.Random(5)
    line = "a line that stands in every one of these texts, with other words on both sides of it"
    data = np.frombuffer("".join("".join(rng.choice("abcdefgh ") for _ in range(80)) + line for _ in range(30)).encode(), np.uint8)
    offs = np.arange(31) * (80 + len(line))
    h, _, first, last, doc = S.anchors(data, offs, 50)
    p = S.T.prefix_hash(data)
    v, s, k = S.strings_of(p, first, last, 50)
    v, raw, least = S._least(v, data, s, 50, doc[k])
    told = {"shard": [7, 8], "kind": [S.STRINGS] * 2, "part": [0, 0], "data": [S.squeezed(raw[:-9]), S.squeezed(raw[-19:])], "size": [v[:-9].tobytes(), v[-19:].tobytes()], "least": [S.squeezed(least[:-9]), S.squeezed(least[-19:] - 100)]}
    sorted_rows, sort = [], S.suffix_sort
    monkeypatch.setattr(S, "suffix_sort", lambda data, start, *a: sorted_rows.append(len(start)) or sort(data, start, *a))
    got = S._strings_told(S.pa.table(told), 50)["doc"].to_pylist()
    assert sum(sorted_rows) == 20
    want = np.concatenate([least[:-19], least[-19:] - 100])
    assert np.array_equal(np.frombuffer(got[0], np.int64), want[:-9]) and np.array_equal(np.frombuffer(got[1], np.int64), want[-19:])
    found = S.HotStrings(S.pa.table({"kind": [S.SEEDS, S.STRINGS], "part": [0, 0], "hash": [S.X.pack(np.unique(S.X.upper(h))), b""], "doc": [b"", least.tobytes()]}), [0], 50, 64)
    monkeypatch.setattr(S, "anchors", None)
    found.note(data, p, h, first, last, doc, np.ones(30, bool), 0, 0)
    begin, end, text = S._spans(*(np.concatenate(x) for x in zip(*found.struck(np.arange(30)), strict=True)))
    assert text.tolist() == list(range(1, 30)) and (end - begin).min() >= len(line)


def test_only_contexts_that_may_share_a_string_are_sorted():
    """Contexts that have a seed in common, but no more of the bytes that every string holds, are related to none."""
    rng = random.Random(6)
    seed, some, other = "the seed in common", *("".join(rng.choice("abcdefgh ") for _ in range(64)) for _ in range(2))
    texts = [some[:32] + seed + some[32:], other[:32] + seed + other[32:], some[:32] + seed + other[32:], "".join(reversed(some[:32])) + seed + "".join(reversed(some[32:]))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    n = len(texts)
    related = lambda k: S._related(S._near(S.T.prefix_hash(data), np.arange(n)[k] * 82, np.full(len(k), 82), np.full(len(k), 32), 50, 0)).tolist()
    assert related([0, 1]) == [False, False] and related([0, 1, 2, 3]) == [True, True, True, False]


def test_a_hot_seed_in_many_texts(docs_of):
    same = "this sentence stands in all of these documents, whatever else they may hold, word by word. "
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randrange(90))) + same * rng.randrange(1, 3) + "".join(rng.choice("vwxyz ") for _ in range(40))) for i in range(150)]
    assert check(docs_of(rows), hot_texts=20) == check(docs_of(rows)) > 10_000


def test_made_overlaps(docs_of):
    rng = random.Random(3)
    for letters in ("ab", "abcdefgh é"):
        pool = "".join(rng.choice(letters) for _ in range(3000))
        rows = []
        for i in range(60):
            t = ""
            for _ in range(rng.randrange(1, 6)):
                k = rng.randrange(len(pool) - 200)
                t += pool[k : k + rng.randrange(20, 160)] + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))
            rows.append((i, t))
        assert check(docs_of(rows)) > 0
        assert check(docs_of(rows), 24) > 0
        for hot in (1, 2, 4):  # all shared seeds are hot, or some
            assert check(docs_of(rows), hot_texts=hot) > 0


def test_odd_rows(odd, docs_of):
    check(odd)
    check(odd.union(odd))
    same = "abc " * 40
    for hot in (1, S.HOT_TEXTS):
        check(docs_of([(None, same), (3, same), (3, same), (5, same), (9, None)]), hot_texts=hot)
    assert S.dedup(docs_of([])).count() == 0


def test_cleaned_keeps_columns(docs_of):
    t = "".join(chr(200 + k % 90) for k in range(80))
    docs = docs_of([(1, "x" + t), (2, "yy" + t + "z"), (3, None)]).selectExpr("*", "4 as __shard", "5 as row", "6 as `odd.name`")
    found = S.dedup(docs, cleaned=True)
    assert found.columns == docs.columns
    got = {r["doc_id"]: r for r in found.collect()}
    assert all((r["__shard"], r["row"], r["odd.name"]) == (4, 5, 6) for r in got.values())
    assert got[1]["text"] == "x" + t and got[2]["text"] == "yyz" and got[3]["text"] is None
    assert got[2]["rank"] == 2 and got[2]["task"] == "k"
