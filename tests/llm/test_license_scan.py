import math
import re

from glossweave.functions.session import table
from glossweave.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text):
    text = low(text)
    w = WORD.findall(text)
    starts, base = [], set()
    for p, label in L.PHRASES.items():
        p = p.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                base.add(label)
    labels, score = set(base), 0.0
    for line in text.split("\n"):
        lw = WORD.findall(line)
        for s in range(0, max(1, -(-(len(lw) - L.BLOCK) // L.STEP) + 1), 1):
            block = set(lw[s * L.STEP : s * L.STEP + L.BLOCK])
            for t, label in L.TEMPLATES.items():
                t = set(t.split())
                if len(block & t) >= math.ceil(L.THRESHOLD * len(t) - 1e-9):
                    labels.add(label)
                    score = max(score, len(block & t) / len(t))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 5)


def check(docs):
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 5)) for r in L.scan(docs).collect())
    want = sorted((r[0], *brute(r[1])) for r in docs.select("doc_id", "text").collect())
    assert got == want
    return got


def test_against_brute_force(spark, sf):
    got = check(table(spark, sf, "documents"))
    assert any(r[2] for r in got)


def test_made_notices(spark, docs_of):
    long_line = "filler " * 90 + "Licensed under CC BY-NC 4.0. " + "filler " * 90
    rows = [
        (1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, long_line), (3, "by nc cc 4 0 under licensed"),
        (4, "MIT License MIT License"), (5, "permission is granted free of charge to any person obtaining a copy of this software"), (6, "gnu general\npublic license"),
    ]
    check(docs_of(rows + rows))


def test_wrapped_notices(spark, docs_of):
    fill = "filler " * 70
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided",
        "gpl": " * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General\n * Public License as published",
    }
    rows = [(10 * k + n, t) for k, t in enumerate(notices.values()) for n, t in enumerate((t, f"{fill}\n{t}\n{fill}", t.replace("\n", "\r\n\r\n"), "x\n\n" + t.replace(" ", "\n")))]
    got = {r["doc_id"]: (r["labels"], r["score"], r["matches"]) for r in L.scan(docs_of(rows)).collect()}
    for k, label in enumerate(notices):
        for n in range(4):
            labels, score, matches = got[10 * k + n]
            assert labels == label and score == 1.0, (label, n)
            assert len({(m["template"], m["first"], m["end"]) for m in matches}) == len(matches)
    # words of two documents never make one block
    parts = notices["bsd"].split("\n")
    assert [r["labels"] for r in L.scan(docs_of(list(enumerate(parts)))).collect()] == ["", ""]


def test_odd_rows(spark, odd, docs_of):
    check(odd)
    assert L.scan(docs_of([])).count() == 0
