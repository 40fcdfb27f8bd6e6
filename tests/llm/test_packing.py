import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from glossweave.functions.session import table
from tokenizers import Tokenizer

from glossweave.llm import packing as P
from glossweave.llm import text as T
from glossweave.llm import token_orc as O
from glossweave.llm.tokenize import Encoder, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def plain(path, text, end):
    return [*LIBRARY[path].encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def twins(n):
    """Two words of n letters on which polynomials modulo 2**64 agree from 1024 letters on."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def check(docs, size=2048):
    rows = P.pack(docs, BYTE, size=size, with_ids=True).collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r[0]].append(plain(BYTE, r[1], 1))
    pieces = defaultdict(Counter)
    for r in rows:
        pieces[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        assert crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    want = defaultdict(Counter)
    for d, many in texts.items():
        for ids in many:
            for k in range(0, len(ids), size):
                want[d][k, len(ids[k : k + size]), crc(ids[k : k + size]), len(ids)] += 1
    assert pieces == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"], r["n_pad"]))
    assert sorted(by) == list(range(len(by)))
    for s in by.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at <= size and {x[2] for x in s} == {0 if at & (at - 1) == 0 else size - at}
    return len(by), sum(r["length"] for r in rows)


def test_pack_against_brute_force(spark, sf):
    n, total = check(table(spark, sf, "documents"))
    assert total / (n * 2048) > 0.97
    check(table(spark, sf, "documents").limit(40), size=64)


def test_odd_rows(odd, docs_of):
    check(odd.union(odd))
    check(docs_of([(k, t) for k, t in enumerate([*twins(1024), *twins(2048), "a <|endoftext|> b"])]))
    assert P.pack(docs_of([]), BYTE).count() == 0


def test_patterns_keep_the_histogram():
    rng = np.random.default_rng(0)
    h = {int(k): int(n) for k, n in zip(range(1, 300), rng.integers(0, 50, 299), strict=True) if n}
    packs = P.patterns(h, 300)
    got = Counter()
    for c, lengths in packs:
        assert sum(lengths) <= 300
        for x in lengths:
            got[x] += c
    assert got == h and len(packs) <= 3 * 300


def test_encoder_gives_the_librarys_ids():
    texts = ["a b", "", " lead", "x  y", "x \n y", "tab\t z", "<|endoftext|> Q", "É é ́x Σ ΟΔΟΣ İ", "\x01 \x02", "don't  I'll 12 345", "a b c", "\x1c x \x1d", "a\u00a0b \u3000c", "ΑΣ. ΑΣ", "dogs' it's. !!a!! b--c-- 4.0. é. x_ _y_ 's. z'll,. \x7f. q\x00 iPhone aB. McX,Y. Zz", " ", "  ", "a ", None, "a <|endoftext|> b", "x<|ENDOFTEXT|>y <|startoftext|>", *twins(1024), *twins(2048), " ".join(twins(64))] * 2
    for path in (BYTE, WORD):
        e = Encoder(path)
        for _ in range(2):
            ids, at = e.encode(pa.array(texts))
            for i, t in enumerate(texts):
                assert ids[at[i] : at[i + 1]].tolist() == plain(path, t, 0)[:-1], t


def test_misleading_hashes_change_no_ids(monkeypatch):
    texts = ["some words here", "other words there, and more", "", "x", None, "words some"]
    real = T.word_hashes
    monkeypatch.setattr(T, "word_hashes", lambda d, s, e: real(d, s, e) & np.uint64(1))
    for path in (BYTE, WORD):
        ids, at = Encoder(path).encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == plain(path, t, 0)[:-1], t


def round_trip(docs):
    got = O.round_trip(docs, WORD).collect()
    want = sorted((r[0], plain(WORD, r[1], 2)) for r in docs.select("doc_id", "text").collect())
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d, len(x), crc(x)) for d, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [d for d, _ in want]


def test_orc_round_trip(spark, sf, odd, docs_of):
    round_trip(table(spark, sf, "documents"))
    round_trip(odd.union(odd))
    assert O.round_trip(docs_of([]), WORD).count() == 0
