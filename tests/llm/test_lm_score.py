import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glossweave.functions.session import table
from glossweave.llm import lm_score as L


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def brute(rows):
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    seen, after = [Counter() for _ in range(4)], defaultdict(set)
    starts = 0
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            starts += 1
            w = ["<s>", *words(t)]
            for k in range(len(w)):
                for n in (1, 2, 3):
                    if k >= n - 1 and (n > 1 or k):
                        g = tuple(w[k - n + 1 : k + 1])
                        seen[n][g] += 1
                        after[g[:-1]].add(g[-1])
    n, v = sum(seen[1].values()), len(seen[1])
    count_of = lambda h: starts if h == ("<s>",) else seen[len(h)][h]
    ds = {k: L.discount(sum(c == 1 for c in seen[k].values()), sum(c == 2 for c in seen[k].values())) for k in (2, 3)}

    def p(context, word):
        if not context:
            return (seen[1][word,] + 1) / (n + v + 1)
        lower, c = p(context[1:], word), count_of(context)
        d = ds[len(context) + 1]
        return lower if not c else max(seen[len(context) + 1][*context, word] - d, 0) / c + d * len(after[context]) / c * lower

    out = []
    for (i, t), h in zip(rows, held, strict=True):
        w = ["<s>", *words(t)]
        base = sum(math.log10(p((), x)) for x in w[1:])
        own = sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w)))
        out.append((str(i), h, len(w) - 1, sum(seen[1][x,] > 0 for x in w[1:]), n, base, own))
    return sorted(out)


def check(docs):
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in L.score(docs).collect())
    want = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)
    return got


def test_against_brute_force(spark, sf):
    got = check(table(spark, sf, "documents"))
    assert np.mean([(x[6] - x[5]) / x[2] for x in got if x[1]]) > 0


def test_frequent_words_stand_in_several_ranges(docs_of, monkeypatch):
    monkeypatch.setattr(L, "HINT", 1)
    docs = docs_of([(k, f"the w{k} of the w{k % 7} and the x{k % 3} of the END") for k in range(80)])
    assert max(L.frequent(docs, 8).values()) > 1
    check(docs)


def test_every_state_sums_to_one():
    rng = np.random.default_rng(3)
    token = np.append(rng.integers(1, 6, 60), 9).astype(np.uint64) << np.uint64(50)
    g = L.Grams(token, np.array([0, 61]), np.array([True]))
    pair, pair_follow = g.pairs()
    count, follow = np.bincount(g.first, weights=pair, minlength=len(g.words)), np.bincount(g.first, weights=pair > 0, minlength=len(g.words))
    end = int(np.flatnonzero(g.words == token[-1])[0])
    count[end] = 1
    start = int(np.flatnonzero(g.words == L.BEGIN)[0])
    auto = L.Automaton(count, follow, np.append(pair, 0), np.append(pair_follow, 0), np.append(g.count, 0), (0.7, 0.6), 61, len(g.words) - 1)
    words = np.array([w for w in range(len(g.words)) if w != start])
    at = {(a, b): k for k, (a, b) in enumerate(zip(g.first.tolist(), g.second.tolist(), strict=True))}
    leaves = {(p, c): k for k, (p, c) in enumerate(zip(g.pair.tolist(), g.third.tolist(), strict=True))}
    for a, b in [*at, (None, start)]:
        if b == end:
            continue
        s = at.get((a, b), -1)
        arcs = np.array([at.get((b, w), len(pair)) for w in words])
        longer = np.array([leaves.get((s, w), len(g.count)) for w in words])
        p = auto.step(words, np.full(len(words), b), arcs, np.full(len(words), s), longer).sum()
        unknown = auto.fail_one[b] * (1 / (61 + len(words) + 1)) * (auto.fail_two[s] if s >= 0 else 1)
        assert np.isclose(p + unknown, 1)


@pytest.mark.parametrize("twice", [False, True])
def test_odd_rows(odd, docs_of, twice):
    check(odd.union(odd) if twice else odd)
    check(docs_of([(None, "a b"), (3, None), (3, "a b b")]))
    assert L.score(docs_of([])).count() == 0
