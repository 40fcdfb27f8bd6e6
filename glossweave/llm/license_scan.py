"""Operator 7: license notices, by an exact set-similarity join of text blocks with templates.

A block is a line's words; longer lines give blocks of ``BLOCK`` words at every ``STEP``, so each run of ``STEP`` words
lies in one. As notices are often wrapped, so does the document's whole word sequence, across its lines. A template's
containment in a block is the share of its distinct words that the block has. Template words are ordered by their number in the whole corpus, rarest first. A block can reach the threshold only if it has one of a
template's first words (prefix filter), enough distinct words (length filter), and if the words from its first common one
on suffice (positional filter); what is left is counted exactly. Only the templates (a fixed table) go to the executors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.session import importable
from glossweave.llm import exchange as X
from glossweave.llm import text as T

# Phrases that are looked for as such, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Short notices and the labels that they give.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
BLOCK, STEP = 64, 32
THRESHOLD = 0.9


class Templates:
    """Templates as rows of a matrix over their words in global order."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], threshold: float):
        self.labels = list(templates.values())
        sets = [sorted(set(t.split()), key=lambda w: (counts.get(w, 0), w)) for t in templates]
        vocab = sorted({w for s in sets for w in s})
        hashes = np.array([T.hash_of(w) for w in vocab], np.uint64)
        order = np.argsort(hashes)
        self.hashes, at = hashes[order], {vocab[k]: i for i, k in enumerate(order)}
        self.member = np.zeros((len(vocab), len(sets)), np.float32)
        self.place = np.full((len(vocab), len(sets)), 1 << 20)
        for t, s in enumerate(sets):
            for i, w in enumerate(s):
                self.member[at[w], t], self.place[at[w], t] = 1, i
        self.size = np.array([len(s) for s in sets])
        self.need = np.array([max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets])
        self.prefix = (self.place <= (self.size - self.need)[None, :]).any(axis=1)


def find(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where each hash stands in a sorted table, or -1."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def blocks(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of blocks over words, from each word's line (or text) number; every run of STEP words of one lies in one."""
    first = np.flatnonzero(np.diff(line, prepend=-1))
    n = np.diff(np.append(first, len(line)))
    per = np.maximum(1, -(-(n - BLOCK) // STEP) + 1)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    s = np.repeat(first, per) + k * STEP
    return s, np.minimum(s + BLOCK, np.repeat(first + n, per))


def word_counts(docs: DataFrame, vocab: list[str]) -> dict[str, int]:
    """How often each of a few words stands in all documents."""
    hashes = np.array([T.hash_of(w) for w in vocab], np.uint64)
    order = np.argsort(hashes)

    def count(batches):
        total = np.zeros(len(vocab), np.int64)
        for b in batches:
            for _, _, data, offs in T.texts(b.column(0)):
                low = T.LOWER[data]
                s, e, _ = T.words(low, offs, T.ALNUM)
                at = find(T.word_hashes(low, s, e), hashes[order])
                total += np.bincount(at[at >= 0], minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(total)], ["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {vocab[r["word"]]: r["n"] for r in rows}


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches of every document.

    ``docs`` has doc_id and text; other columns are left out. Null and empty texts have no words and no labels; repeated
    rows give a row each; no rows give no rows. matches lists (template, first word, end word, containment) of all blocks
    that reach the threshold; score is the largest containment among them, else 0.
    """
    importable(docs.sparkSession)
    vocab = sorted({w for t in templates for w in t.split()})
    table = Templates(templates, word_counts(docs, vocab), threshold)
    runs = [(np.array([T.hash_of(w) for w in p.split()], np.uint64), label) for p, label in phrases.items()]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(data: np.ndarray, offs: np.ndarray):
        n = len(offs) - 1
        low = T.LOWER[data]
        s, e, first = T.words(low, offs, T.ALNUM)
        h = T.word_hashes(low, s, e)
        doc = np.repeat(np.arange(n), np.diff(first))
        places: list[tuple[np.ndarray, str]] = []
        for run, label in runs:
            m = max(0, len(h) - len(run) + 1)
            hit = np.ones(m, bool)
            for k, w in enumerate(run):
                hit &= h[k : k + m] == w
            at = np.flatnonzero(hit)
            places.append((at[doc[at] == doc[at + len(run) - 1]], label))
        # blocks with a prefix word
        at = find(h, table.hashes)
        known = np.flatnonzero(at >= 0)
        newline = np.cumsum(data == 10)
        line = (newline[s] if len(s) else np.zeros(0, np.int64)) + doc
        bs, be = (np.concatenate(x) for x in zip(blocks(line), blocks(doc), strict=True))
        bs, be = np.divmod(np.unique(bs * (len(h) + 1) + be), len(h) + 1)
        rare = known[table.prefix[at[known]]]
        below = np.searchsorted(rare, bs)
        cand = np.flatnonzero(np.searchsorted(rare, be) > below)
        out = []
        if len(cand):
            a, z = np.searchsorted(known, bs[cand]), np.searchsorted(known, be[cand])
            row = np.repeat(np.arange(len(cand)), z - a)
            word = at[known[np.repeat(a - np.cumsum(z - a) + (z - a), z - a) + np.arange(len(row))]]
            has = np.zeros((len(cand), len(table.hashes)), np.float32)
            has[row, word] = 1
            # length and positional filters: enough words in the block, and from the first common one on in the template
            long_enough = (be - bs)[cand][:, None] >= table.need[None, :]
            least = np.full((len(cand), len(table.size)), 1 << 20)
            np.minimum.at(least, row, table.place[word])
            left = table.size[None, :] - least >= table.need[None, :]
            common = has @ table.member
            for r, t in zip(*np.nonzero(long_enough & left & (common >= table.need[None, :])), strict=True):
                b = cand[r]
                out.append((doc[bs[b]], int(t), int(bs[b] - first[doc[bs[b]]]), int(be[b] - first[doc[bs[b]]]), float(common[r, t] / table.size[t])))
        return first, doc, places, out

    def rows(batches):
        X.trim()
        for batch in batches:
            for i, j, data, offs in T.texts(batch.column(1)):
                first, doc, places, found = one(data, offs)
                n = j - i
                n_base, lo, hi = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
                labels: list[set] = [set() for _ in range(n)]
                for at, label in places:
                    d = doc[at]
                    n_base += np.bincount(d, minlength=n)
                    np.minimum.at(lo, d, at - first[d])
                    np.maximum.at(hi, d, at - first[d])
                    for x in np.unique(d):
                        labels[x].add(label)
                base = [",".join(sorted(x)) for x in labels]
                score, matches = np.zeros(n), [[] for _ in range(n)]
                for d, t, s, e, share in found:
                    labels[d].add(table.labels[t])
                    score[d] = max(score[d], share)
                    matches[d].append({"template": t, "first": s, "end": e, "containment": share})
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.diff(first)), pa.array(n_base), pa.array(lo, mask=none), pa.array(hi, mask=none), pa.array(base, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score), pa.array(matches, pa.list_(pa.struct([("template", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template:long,first:long,end:long,containment:double>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)
