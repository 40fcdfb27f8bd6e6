import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from glossweave.llm import text as T
from glossweave.llm import tokenize as K

BYTE, WORD = K.vocabulary("byte_bpe_50k.json"), K.vocabulary("word_bpe_49k.json")


def same_as_library(e, path, texts):
    ids, at = e.encode(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for i, w in enumerate(want):
        assert ids[at[i] : at[i + 1]].tolist() == w.ids, texts[i]


def words(n, letters, seed):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(n)]


def test_small_letters_go_past_normalizer_and_expression():
    class Never:
        def __getattr__(self, name):
            raise AssertionError(name)

    e = K.Encoder(WORD)
    e.tokenizer = Never()
    same_as_library(e, WORD, [" ".join(words(3000, "abcdefghijklmnopqrstuvwxyzßàéêïðñöøÿ", k)) for k in range(4)] + ["ABC Def GHÉ".lower()])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_letters_and_signs_of_latin_and_beyond(path):
    some = "abyzABYZ019'.,-÷×ºªµßÀÉÞàéíþÿÃ¿\u009f ­ĀāſİıŉΣσς̧́​éК文\U0001f600_~"
    e = K.Encoder(path)
    for k in range(3):
        same_as_library(e, path, [" ".join(words(2000, some, k)), *(f"a{c}b {c} {c}{c} é{c} {c}é" for c in map(chr, range(0x80, 0x180)))])


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("most", [{"KEEP": 700}, {"KEEP_BYTES": 5000}, {"KEEP": 1 << 30}])
@pytest.mark.parametrize("bits", [64, 20])
def test_table_grows_collides_and_starts_anew(monkeypatch, path, most, bits):
    for name, n in most.items():
        monkeypatch.setattr(K, name, n)
    real = T.word_hashes
    monkeypatch.setattr(T, "word_hashes", lambda d, s, e: real(d, s, e) & np.uint64((1 << bits) - 1) | np.uint64((1 << 64) - (1 << bits)) if bits < 64 else real(d, s, e))
    e = K.Encoder(path)
    e.slot, e.key = np.full(4, -1, np.int32), np.zeros(2, np.uint64)
    e.ids, e.start, e.raw, e.raw_at = np.zeros(2, np.uint32), np.zeros(2, np.int64), np.zeros(2, np.uint8), np.zeros(2, np.int64)
    for k in range(6):
        same_as_library(e, path, [" ".join(words(900, "abcdeé,", k % 4)), "", " ".join(words(50, "abc", k))])


def test_words_stay_known_beyond_600_000():
    letters = "bcdfghjklm"
    many = [" ".join(f"{letters[n // 10**5]}{letters[n // 10**4 % 10]}{letters[n // 1000 % 10]}{letters[n // 100 % 10]}{letters[n // 10 % 10]}{letters[n % 10]}" for n in range(a, a + 50_000)) for a in range(0, 650_000, 50_000)]
    e = K.Encoder(WORD)
    for t in many:
        e.encode(pa.array([t]))
    first, *_ = e.encode(pa.array(many[:1]))
    assert e.known == 650_000
    assert first.tolist() == Tokenizer.from_file(WORD).encode(many[0], add_special_tokens=False).ids
