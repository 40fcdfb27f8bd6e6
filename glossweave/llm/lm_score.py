"""Operator 3: texts scored by a weighted backoff automaton over smoothed n-grams counted in all training documents.

States are the contexts that training texts have: pairs of words, single words, and a root. An n-gram that was seen is an arc
out of its context's state; its weight is its discounted share plus what the failure arc gives it. A word without an arc
takes the state's failure arc, which leads to the context less its first word and weighs the mass that discounting
freed: D times the context's distinct successors over its count. The root's arcs are add-one unigrams, one of them for
the unknown word. In every state the words' probabilities sum to one. D is n1 / (n1 + 2 n2) of each order, from the
numbers of n-grams that the whole corpus has once and twice. A text is read once from left to right; the state after a
word is the longest context that is one. Nothing is cut: counts cover all training documents, whatever their number.

No task holds the whole automaton. A shard of documents sends its n-grams as a trie: words, their successors, and theirs,
with counts. Tries are dealt by ranges of the first word's hash, so a range has whole contexts and knows counts, distinct
successors and numbers of counts; it answers each shard, in the order that the shard sent, with what other shards have. The
successors of a word that holds more than its share of a range are dealt over as many ranges as that takes.

Words are keyed 64-bit hashes; a successor is named inside its context by 48 bits of its hash, one after two words by 40.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm import exchange as X
from glossweave.llm import text as T
from glossweave.llm.toxicity import fold

#: Hashes of the state before a text's first word and of the token after its last.
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bytes of a successor's name after one word and after two.
SECOND, THIRD = 6, 5
#: Of how many slices of texts one is looked at when frequent words are sought; this only decides how work is dealt.
HINT = 8
#: Tokens that are scored at once.
STEP = 1 << 18
#: Discounts stay inside these.
LEAST, MOST = 0.05, 0.95


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' tokens in a row, first token of each text): a text's words and END."""
    low = T.LOWER[data]
    s, e, first = T.words(low, offs, T.SOLID)
    n = np.diff(first)
    out = np.full(len(s) + len(n), END)
    out[np.arange(len(s)) + np.repeat(np.arange(len(n)), n)] = T.word_hashes(low, s, e)
    return out, first + np.arange(len(n) + 1)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Rows at which one of some sorted columns changes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(columns[0]) else False
    return np.flatnonzero(new)


def _sums(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, heads) if len(heads) else np.zeros(0, np.int64)


def _owner(heads: np.ndarray, n: int) -> np.ndarray:
    """The run of each of n rows."""
    out = np.zeros(n, bool)
    out[heads] = True
    return np.cumsum(out, dtype=np.int32 if n < 1 << 31 else np.int64) - 1


def _sorted(major: np.ndarray, minor: np.ndarray, bits: int) -> np.ndarray:
    """The order by two columns, of which the second has at most so many bits."""
    if len(major) and int(major.max()).bit_length() + bits <= 64:
        return np.argsort(major.astype(np.uint64) << np.uint64(bits) | minor.astype(np.uint64))
    return np.lexsort((minor, major))


class Grams:
    """The tries of a shard's texts: words; pairs by (word, successor); leaves by (pair, successor).

    Each token is one event: the word before it, itself, and the one after it (none after END)."""

    def __init__(self, token: np.ndarray, first: np.ndarray, train: np.ndarray):
        """``first``: first token of each text, and the end; ``train``: which texts are learned from."""
        self.words, at = np.unique(np.append(token, BEGIN), return_inverse=True)
        at = at.ravel().astype(np.int32)
        n, none = len(token), np.int32(len(self.words))
        self.token = at[:n]
        self.before, after = np.empty(n, np.int32), np.empty(n, np.int32)
        self.before[1:], after[:-1] = at[: max(0, n - 1)], at[1:n]
        self.before[first[:-1]], after[first[1:] - 1] = at[n], none
        del at
        learned = np.repeat(train, np.diff(first))
        base = len(self.words) + 1
        if base**3 < 1 << 64:
            key = (self.before.astype(np.uint64) * np.uint64(base) + self.token.astype(np.uint64)) * np.uint64(base) + after.astype(np.uint64)
            order = np.argsort(key)
            key = key[order]
            heads = _heads(key)
            del key
        else:
            order = np.lexsort((after, self.token, self.before))
            heads = _heads(self.before[order], self.token[order], after[order])
        self.leaf = np.empty(n, np.int32)  # of each event
        self.leaf[order] = _owner(heads, n)
        self.count = _sums(learned[order].astype(np.int64), heads)
        rows = order[heads]
        a, b, self.third = self.before[rows], self.token[rows], after[rows]
        self.pair_heads = _heads(a, b)
        self.pair = _owner(self.pair_heads, len(rows)).astype(np.int32)  # of each leaf
        self.first, self.second = a[self.pair_heads], b[self.pair_heads]
        self.none = none

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(count, distinct successors) of each pair in the shard's training texts."""
        return _sums(self.count, self.pair_heads), _sums(((self.count > 0) & (self.third != self.none)).astype(np.int64), self.pair_heads)

    def dealt(self, ends: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(the range of each pair, pairs in the order of ranges)."""
        part = np.searchsorted(ends, self.words, "right").clip(max=len(ends) - 1)[self.first]
        for word, k in hot.items():
            w = np.searchsorted(self.words, np.uint64(word))
            if w < len(self.words) and self.words[w] == word:
                a, z = np.searchsorted(self.first, [w, w + 1])
                part[a:z] = (part[a:z] + (self.words[self.second[a:z]] >> np.uint64(9)).astype(np.int64) % k) % len(ends)
        return part, np.argsort(part, kind="stable")


def _places(hot: dict[int, int], ends: np.ndarray) -> list[np.ndarray]:
    """The frequent words that each range gets successors of, sorted."""
    out: list[list[int]] = [[] for _ in ends]
    for word, k in hot.items():
        base = min(int(np.searchsorted(ends, np.uint64(word), "right")), len(ends) - 1)
        for j in range(k):
            out[(base + j) % len(ends)].append(word)
    return [np.array(sorted(x), np.uint64) for x in out]


def _narrow(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _named(words: np.ndarray, width: int) -> np.ndarray:
    """Names of successors: the upper bytes of their hashes, never 0, and 0 for none."""
    return np.append(np.maximum(words >> np.uint64(64 - 8 * width), np.uint64(1)), np.uint64(0))


class Listing:
    """A shard's trie as it is sent to each range: the rows of words, pairs and leaves, in order."""

    def __init__(self, g: Grams, ends: np.ndarray, hot: dict[int, int]):
        part, pairs = g.dealt(ends, hot)
        cut = np.searchsorted(part[pairs], np.arange(len(ends) + 1))
        sizes = np.diff(np.append(g.pair_heads, len(g.pair)))
        self.parts = []
        for p, places in enumerate(_places(hot, ends)):
            own = pairs[cut[p] : cut[p + 1]]
            if not len(own) and not len(places):
                continue
            first = g.words[g.first[own]]
            words = np.union1d(first, places) if len(places) else first[_heads(first)] if len(first) else first
            n = sizes[own]
            leaves = np.repeat(g.pair_heads[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            self.parts.append((p, words, np.searchsorted(first, words, "right") - np.searchsorted(first, words), own, n, leaves))


_SENT = "part int, shard int, words binary, fans binary, seconds binary, thirds_of binary, thirds binary, counts binary"
_TOLD = "part int, shard int, words binary, follow binary, pairs binary, pair_follow binary, leaves binary, numbers array<long>"


def _read(own: pa.Table) -> tuple[Grams, list[int]]:
    """(tries, tokens of each text) of a shard's texts."""
    got, firsts, at = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offs in T.texts(own["text"]):
        token, first = tokens(data, offs)
        got.append(token)
        firsts.append(first[1:] + at)
        at += len(token)
    first = np.concatenate(firsts)
    train = ~own["held_out"].to_numpy().astype(bool)
    return Grams(np.concatenate(got) if got else np.zeros(0, np.uint64), first, train), first


def _sent(dealt: DataFrame, parts: list[int], hot: dict[int, int]) -> DataFrame:
    ends = X.bounds(len(parts), 64)

    def send(own: pa.Table) -> pa.Table:
        g, _ = _read(own)
        second, third = _named(g.words, SECOND), _named(g.words, THIRD)
        shard, rows = own["__shard"][0].as_py(), []
        for p, words, fans, pairs, n, leaves in Listing(g, ends, hot).parts:
            rows.append((parts[p], shard, X.pack(words), X.pack_counts(fans), _narrow(second[g.second[pairs]], SECOND), X.pack_counts(n), _narrow(third[g.third[leaves]], THIRD), X.pack_counts(g.count[leaves])))
        X.trim()
        names = [f.split()[0] for f in _SENT.split(", ")]
        kinds = [pa.int32()] * 2 + [pa.binary()] * 6
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))})

    return dealt.groupBy("__shard").applyInArrow(send, _SENT)


def _told(rows: DataFrame, shards: list[int], hot: dict[int, int]) -> DataFrame:
    """To each shard what others have of its words, pairs and leaves of a range; to all the range's numbers: tokens, words, pairs and triples that stand once and twice."""
    frequent = np.array(sorted(hot), np.uint64)

    def count(group: pa.Table) -> pa.Table:
        shard = group["shard"].to_pylist()
        read = lambda c, f: [f(x) for x in group[c].to_pylist()]
        words, fans, n = read("words", lambda x: X.unpack(x)[0]), read("fans", X.unpack_counts), read("thirds_of", X.unpack_counts)
        seconds, thirds, counts = read("seconds", lambda x: _wide(x, SECOND)), read("thirds", lambda x: _wide(x, THIRD)), read("counts", X.unpack_counts)
        vocab, word = np.unique(np.concatenate(words), return_inverse=True)
        word = word.ravel()
        # pairs of all shards, alike ones together
        of_word = np.repeat(word, np.concatenate(fans))
        order = _sorted(of_word, np.concatenate(seconds), 8 * SECOND)
        heads = _heads(of_word[order], np.concatenate(seconds)[order])
        pair = np.empty(len(order), np.int64)
        pair[order] = _owner(heads, len(order))
        word_of_pair = of_word[order][heads]
        # leaves likewise
        third, own = np.concatenate(thirds), np.concatenate(counts)
        of_pair = np.repeat(pair, np.concatenate(n))
        order = _sorted(of_pair, third, 8 * THIRD)
        heads = _heads(of_pair[order], third[order])
        leaf = np.empty(len(order), np.int64)
        leaf[order] = _owner(heads, len(order))
        pair_of_leaf, real = of_pair[order][heads], third[order][heads] > 0
        total = _sums(own[order], heads)
        bins = lambda at, x, size: np.bincount(at, weights=x, minlength=size).astype(np.int64)
        pair_total, pair_follow = bins(pair_of_leaf, total, len(word_of_pair)), bins(pair_of_leaf, (total > 0) & real, len(word_of_pair))
        word_total, follow = bins(word_of_pair, pair_total, len(vocab)), bins(word_of_pair, pair_total > 0, len(vocab))
        told = {s: [] for s in shards}
        w = p = l = 0
        for k, s in enumerate(shard):
            i, j, m = np.arange(w, w + len(words[k])), np.arange(p, p + len(seconds[k])), np.arange(l, l + len(thirds[k]))
            w, p, l = w + len(i), p + len(j), l + len(m)
            c = counts[k]
            owner = np.repeat(np.arange(len(j)), n[k])
            own_pair = bins(owner, c, len(j))
            own_follow = bins(owner, (c > 0) & (thirds[k] > 0), len(j))
            by = np.repeat(np.arange(len(i)), fans[k])
            told[s] = [X.pack_counts(x) for x in (word_total[word[i]] - bins(by, own_pair, len(i)), follow[word[i]] - bins(by, own_pair > 0, len(i)), pair_total[pair[j]] - own_pair, pair_follow[pair[j]] - own_follow, total[leaf[m]] - c)]
        starts = vocab == BEGIN
        alone = (word_total > 0) & ~starts & (X.lookup(vocab, frequent) < 0)  # frequent words stand in several ranges
        triples = total[real]
        numbers = [int(word_total[~starts].sum()), int(word_total[starts].sum()), int(alone.sum()), *(int((x == k).sum()) for x in (pair_total, triples) for k in (1, 2))]
        X.trim()
        cols = [pa.array([told[s][k] if told[s] else None for s in shards], pa.binary()) for k in range(5)]
        return pa.table([pa.array([group["part"][0].as_py()] * len(shards), pa.int32()), pa.array(shards, pa.int32()), *cols, pa.array([numbers] * len(shards), pa.list_(pa.int64()))], names=[f.split()[0] for f in _TOLD.split(", ")])

    return rows.groupBy("part").applyInArrow(count, _TOLD)


def frequent(docs: DataFrame, parts: int) -> dict[int, int]:
    """Words that hold more than half of a range's share of tokens, and the start, with the number of ranges that each takes.

    This decides how work is dealt, never a result; it is read off one of ``HINT`` slices of the texts."""

    def look(batches):
        X.trim()
        seen: dict[int, int] = {}
        total = texts = k = 0
        for b in batches:
            for i, j, data, offs in T.texts(b.column(0)):
                if (k := k + 1) % HINT != 1 % HINT:
                    continue
                token, _ = tokens(data, offs)
                total, texts = total + len(token), texts + j - i
                u, n = np.unique(token, return_counts=True)
                for w, c in zip(u[n > len(token) / (4 * parts)].tolist(), n[n > len(token) / (4 * parts)].tolist(), strict=True):
                    seen[w] = seen.get(w, 0) + c
        seen.pop(int(END), None)
        seen[int(BEGIN)] = texts
        seen = {w: c for w, c in seen.items() if c > total / (4 * parts)}
        keys = np.array(list(seen), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, 0)), pa.array([*seen.values(), 0]), pa.array([0] * len(seen) + [total])], ["word", "n", "total"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(look, "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    total = found.agg(F.sum("total")).first()[0] or 0
    rows = found.where(F.col("n") > total / (2 * parts)).collect()  # at most twice as many as ranges
    out = {int(BEGIN): 1}
    for r in rows:
        out[r["word"] % (1 << 64)] = min(parts, -(-2 * r["n"] * parts // max(1, total)))
    return out


class Automaton:
    """States of one shard's texts: contexts of two words and of one with their arcs and failure arcs, and the root."""

    def __init__(self, count: np.ndarray, follow: np.ndarray, pair: np.ndarray, pair_follow: np.ndarray, leaf: np.ndarray, discounts: tuple[float, float], n_tokens: int, n_types: int):
        self.count, self.pair, self.leaf, self.discounts = count, pair, leaf, discounts
        self.root = (count + 1.0) / (n_tokens + n_types + 1)
        #: Weights of failure arcs; a context that no training text has is no state, so nothing is lost on the way down.
        self.fail_one = np.where(count > 0, discounts[0] * follow / np.maximum(1, count), 1.0)
        self.fail_two = np.where(pair > 0, discounts[1] * pair_follow / np.maximum(1, pair), 1.0)

    def step(self, word: np.ndarray, before: np.ndarray, arc: np.ndarray, state: np.ndarray, long_arc: np.ndarray) -> np.ndarray:
        """Probabilities of words, each after ``before`` and, where ``state`` is not -1, after that pair.

        ``arc`` numbers the pair of before and word, ``long_arc`` the leaf of state and word; an arc's weight is its own
        share and its part of the failure arc; without a count it is no arc, and the failure arc alone remains."""
        n, d = self.count[before], self.discounts[0]
        one = np.where(n > 0, np.maximum(self.pair[arc] - d, 0) / np.maximum(1, n), 0.0) + self.fail_one[before] * self.root[word]
        n, d = np.where(state >= 0, self.pair[state], 0), self.discounts[1]
        two = np.where(n > 0, np.maximum(self.leaf[long_arc] - d, 0) / np.maximum(1, n), 0.0)
        return two + np.where(state >= 0, self.fail_two[state], 1.0) * one


def discount(once: int, twice: int) -> float:
    return min(MOST, max(LEAST, once / (once + 2 * twice))) if once + twice else MOST


def score(docs: DataFrame, mod: int = 7, out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``docs`` has doc_id and text; other columns are left out. Texts whose crc32(doc_id as text) modulo ``mod`` is ``out`` are
    scored but not learned from. Null and empty texts are one end token; repeated rows are learned from and scored as often
    as they stand; a null doc_id counts as the empty text for the fold; no rows give no rows.
    """
    names = X.shard_labels(docs)
    dealt = X.sharded(docs, (fold(mod) == out).alias("held_out"))
    hot = frequent(docs, len(names))
    back = _told(_sent(dealt, names, hot), names, hot)
    ends, number = X.bounds(len(names), 64), {name: k for k, name in enumerate(names)}

    def one(own: pa.Table, got: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", own.schema.field("doc_id").type), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
        if not own.num_rows:
            return schema.empty_table()
        g, first = _read(own)
        pair, pair_follow = g.pairs()
        leaf = g.count.copy()
        count, follow = np.zeros((2, len(g.words) + len(hot)), np.int64)
        frequent_words = np.array(sorted(hot), np.uint64)
        where = lambda w: np.where((at := X.lookup(w, g.words)) >= 0, at, len(g.words) + np.searchsorted(frequent_words, w))
        np.add.at(count, g.first, pair)
        np.add.at(follow, g.first, pair > 0)
        told = {number[p]: k for k, p in enumerate(got["part"].to_pylist())}
        answer = {c: got[c] for c in ("words", "follow", "pairs", "pair_follow", "leaves")}
        for p, words, _, own_pairs, _, leaves in Listing(g, ends, hot).parts:
            more = [X.unpack_counts(x[told[p]].as_py()) for x in answer.values()]
            at = where(words)
            count[at] += more[0]
            follow[at] += more[1]
            pair[own_pairs] += more[2]
            pair_follow[own_pairs] += more[3]
            leaf[leaves] += more[4]
        n = np.array(got["numbers"].to_pylist()).sum(axis=0).tolist()
        n_tokens = n[0] + n[1]  # each training text starts and ends once
        real = frequent_words[frequent_words != BEGIN]
        n_types = n[2] + int((count[where(real)] > 0).sum()) + (n[1] > 0)
        for special, total in ((END, n[1]), (BEGIN, n[1])):
            at = X.lookup(np.array([special]), g.words)[0]
            count[at] = total
        auto = Automaton(count, follow, pair, pair_follow, leaf, (discount(n[3], n[4]), discount(n[5], n[6])), n_tokens, n_types)
        arc = g.pair[g.leaf]
        heads = first[:-1]
        state, long_arc = np.empty_like(arc), np.empty_like(arc)
        state[1:], long_arc[1:] = arc[:-1], g.leaf[:-1]
        state[heads], long_arc[heads] = -1, 0
        p, base = np.empty(len(arc)), np.log10(auto.root)[g.token]
        for i in range(0, len(arc), STEP):
            k = slice(i, i + STEP)
            p[k] = np.log10(auto.step(g.token[k], g.before[k], arc[k], state[k], long_arc[k]))
        add = lambda x: np.add.reduceat(x, heads)
        size = np.diff(first)
        X.trim()
        return pa.table([own["doc_id"], own["held_out"], size, add((count[g.token] > 0).astype(np.int64)), np.full(len(size), n_tokens), add(base), add(p)], schema=schema)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("__shard").cogroup(back.groupBy("shard")).applyInArrow(one, schema)
