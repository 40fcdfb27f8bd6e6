import numpy as np

from glossweave.functions.session import table
from glossweave.llm import topk


def brute(rows, k=20, every=20):
    use = [(i, np.floor(64.0 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, x in use:
        if q % every == 0 and q not in out:
            out[q] = sorted(((-int(x @ y), i) for i, y in use if i != q))[:k]
    return {(q, r + 1, i, -s) for q, best in out.items() for r, (s, i) in enumerate(best)}, sum(map(len, out.values()))


def check(df, **kw):
    got = [tuple(r) for r in topk.search(df, **kw).select("query_id", "rank", "vec_id", "score").collect()]
    want, n = brute([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()], **{a: kw[a] for a in ("k", "every") if a in kw})
    assert len(got) == n and set(got) == want


def test_against_brute_force(spark, sf):
    df = table(spark, sf, "embeddings")
    check(df)
    check(df, k=3, every=7, block=16)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5, -0.1]), (1, [1.0, 0.5, -0.1]), (2, None), (20, [None, 1.0, 2.0]), (21, [nan, 1.0, 2.0]), (40, [inf, 1.0, 2.0]), (3, [0.0, 0.0, 0.0]), (60, [-1.0, -1.0, -1.0]), (None, [1.0, 1.0, 1.0]), (5, [2.0, 1.0, 0.0]), (5, [2.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    check(df)
    check(df, k=2)
    assert topk.search(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [0.25] * 8) for i in range(300)], "vec_id long, embedding array<double>")
    check(same)


def test_vectors_of_several_lengths(spark):
    rows = [(i, [float(i % 5)] * (2 + i % 3)) for i in range(90)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, block=2).collect()
    size = {i: len(v) for i, v in rows}
    assert all(size[r["query_id"]] == size[r["vec_id"]] for r in got) and len(got) == 5 * 4
    for n in (2, 3, 4):
        same = [r for r in rows if size[r[0]] == n]
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if size[r["query_id"]] == n} == brute(same, 4)[0]
