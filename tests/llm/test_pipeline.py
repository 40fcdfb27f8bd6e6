import re

import pytest

cp = pytest.importorskip("corpus_pipeline")
from glossweave.functions.session import stored, table  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_each_stage_on_its_own_input(spark, sf):
    docs = table(spark, sf, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    seen = [docs]
    for name, stage in cp.STAGES[:-1]:
        seen.append(stored(stage(spark, seen[-1], sf), "stage"))
        assert seen[-1].columns == docs.columns, name
    rows = [{r["doc_id"]: r for r in d.collect()} for d in seen]
    gone = set(rows[0]) - set(rows[1])
    assert gone and all(labels.get(i) != 1 for i in gone)
    assert not any(labels.get(i) == 0 for i in rows[1])
    # one of each group stays
    from test_jaccard import brute as groups

    want = {i for i, _, c in groups([(i, r["text"]) for i, r in rows[1].items()], 80, 5) if i == c}
    assert set(rows[2]) == want and all(rows[2][i] == rows[1][i] for i in want)
    # repeated strings are struck out
    from test_suffix_dedup import brute as kept

    sizes = {int(i): n - k for i, n, k, _, _ in kept([(i, r["text"]) for i, r in rows[2].items()], 50)}
    for i, r in rows[3].items():
        assert sizes[i] - 6 <= len(r["text"].encode()) <= sizes[i] and r["n_chars"] == len(r["text"])
        if sizes[i] == len(rows[2][i]["text"].encode()):
            assert r == rows[2][i]
    # no window of the benchmark is left, and documents without one are as they were
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = WORD.findall(low(r["text"]))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    for i, r in rows[4].items():
        before, after = (WORD.findall(low(x["text"])) for x in (rows[3][i], r))
        hit = any(tuple(before[k : k + 10]) in windows for k in range(len(before)))
        assert hit == (r["text"] != rows[3][i]["text"])
        assert not any(tuple(after[k : k + 10]) in windows for k in range(len(after)))
    from test_packing import check

    check(seen[-1])


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 50


def test_odd_rows(spark, odd, tmp_path, sf):
    table(spark, sf, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "odd")
    assert docs.count() >= 1
