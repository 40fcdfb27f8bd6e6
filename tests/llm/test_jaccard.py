import random
import re

import numpy as np

from glossweave.functions.session import table
from glossweave.llm import exchange as X
from glossweave.llm import jaccard as J


def sets_of(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, percent, words=3):
    sets = [(i, sets_of(t, words)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = sorted((len(s), i, s) for i, s in sets if s)
    for k, (n, i, s) in enumerate(by_size):
        for m, j, t in by_size[k + 1 :]:
            if percent * m > 100 * n:
                break
            both = len(s & t)
            if 100 * both >= percent * (n + m - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets)


def check(docs, percent=90, words=3, **kw):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.groups(docs, percent=percent, words=words, **kw).collect())
    want = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], percent, words)
    assert got == want
    return sum(a != c for a, _, c in got)


def near_copies(n, seed=7):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.4:
            w = w[: rng.randrange(250, 300)]
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(n + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))) + " " + passage) for i in range(n)]
    return rows


def test_against_brute_force(spark, sf):
    assert check(table(spark, sf, "documents")) > 10
    assert check(table(spark, sf, "documents"), 80, 5) > 10


def test_words_on_which_plain_polynomials_agree(docs_of):
    from test_packing import twins

    rows = [(k, f"{a} {b} {a}") for k, (a, b) in enumerate((twins(1024), twins(1024)[::-1], twins(2048), twins(2048)[::-1]), 1)]
    got = {r["doc_id"]: r["component_id"] for r in J.groups(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_near_copies_and_tiles(docs_of):
    docs = docs_of(near_copies(90))
    assert check(docs) > 20
    check(docs, block=8)
    check(docs, percent=80, block=16)
    check(docs, percent=80, words=5, block=16)


def test_large_families_in_several_parts(docs_of):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for c in range(3):  # parts that share most words, but too few n-grams to link
        own = [f"c{c}x{k}" if k % 9 == 0 else w for k, w in enumerate(base)]
        for _ in range(40):
            w = list(own)
            w[rng.randrange(200)] = f"d{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    w = list(base)
    for k in range(0, 120, 2):  # a chain whose ends are far apart
        w[k] = f"e{k}"
        rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join(base[: 60 + 7 * k])) for k in range(20)]  # sizes of many bands
    docs = docs_of(rows)
    for block in (4, 16, 64):
        assert check(docs, block=block) > 100


def test_short_sets_link_with_larger_ones(docs_of):
    words = [f"s{k}" for k in range(14)]
    rows = [(1, words[:11]), (2, words[:12]), (3, words[:13])]  # a chain of 9, 10 and 11 n-grams
    rows += [(4, [f"t{k}" for k in range(12)]), (5, [f"t{k}" for k in range(1, 12)])]
    # all sizes, each with a word less at either end
    for n in range(1, 17):
        own = [f"u{n}x{k}" for k in range(n)]
        rows += [(10 * n + k, w) for k, w in enumerate((own, own[1:], own[:-1], own[1:-1]), 10)]
    docs = docs_of([(i, " ".join(w)) for i, w in rows])
    got = {r["doc_id"]: r["component_id"] for r in J.groups(docs).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 4]
    assert check(docs) > 10
    check(docs, percent=80)
    check(docs, block=2)


def test_odd_rows(spark, odd, docs_of):
    check(odd)
    twice = J.groups(odd.union(odd)).collect()
    assert len(twice) == 20 and {r["component_id"] for r in twice if r["doc_id"] in (5, 6)} == {5}
    one = J.groups(docs_of([(3, "a b c d e"), (7, "a b c d e"), (7, "f g h"), (8, "f g h"), (7, "u v w x")])).collect()
    assert [r["component_id"] for r in one] == [3] * 5
    nulls = J.groups(docs_of([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e")])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in nulls) == [("3", 3, "3"), ("None", 3, "None"), ("None", 3, "None")]
    assert J.groups(docs_of([])).count() == 0


def test_packed_hashes():
    rng = np.random.default_rng(2)
    for v in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.unique(rng.integers(0, 1 << 48, 500).astype(np.uint64)), np.array([5, 1 << 47], np.uint64)):
        c = rng.integers(1, 4, len(v))
        a, b = X.unpack(X.pack(v, c))
        assert a.tolist() == v.tolist() and b.tolist() == c.tolist()
