"""Positions of pages and of meanings by energy descent, and the graph of meanings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.operators.clustering import LIMIT, Component, _rng, build, per_component

# Rest lengths of edges, strengths and reach of repulsion, and the span of random starts.
PAGE_REST, SKELETON_REST, REPULSION, ALT_REACH, SPAN = 1.0, 2.0, 40.0, 10.0, 100.0
#: Least distance; nothing is divided by less.
EPSILON = 1e-6


class Energy:
    """Springs along edges and repulsion between pairs, of n points in the plane."""

    def __init__(self, n: int, edges: list[tuple[int, int, float]], pairs: list[tuple[int, int]], rest: float, pair_weight: float = 1.0, alternative: bool = False):
        self.n, self.rest, self.times, self.alternative = n, rest, pair_weight, alternative
        self.a, self.b = (np.array([e[k] for e in edges], int) for k in (0, 1))
        self.w = np.array([e[2] for e in edges], float)
        self.p, self.q = (np.array([x[k] for x in pairs], int) for k in (0, 1))

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """(energy, gradient) at flattened positions."""
        at = x.reshape(self.n, 2)
        out = np.zeros_like(at)

        def pull(i, j, d, slope):
            step = slope[:, None] * d
            np.add.at(out, i, step)
            np.add.at(out, j, -step)

        d = at[self.a] - at[self.b]
        r = np.maximum(EPSILON, np.hypot(*d.T))
        value = float((self.w * (r - self.rest) ** 2).sum())
        pull(self.a, self.b, d, 2 * self.w * (r - self.rest) / r)
        d = at[self.p] - at[self.q]
        r = np.maximum(EPSILON, np.hypot(*d.T))
        if self.alternative:
            value += self.times * float((REPULSION * (r - ALT_REACH) ** 2).sum())
            pull(self.p, self.q, d, self.times * 2 * REPULSION * (r - ALT_REACH) / r)
        else:
            value += self.times * float((REPULSION / r).sum())
            pull(self.p, self.q, d, -self.times * REPULSION / r**3)
        return value, out.ravel()


def descend(energy: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 200, tolerance: float = 1e-5) -> np.ndarray:
    """Nonlinear conjugate gradients (Polak-Ribiere, restarted) with backtracking; energy never rises."""
    value, g = energy(x)
    d, step = -g, 1.0
    for _ in range(rounds):
        slope = g @ d
        if slope >= 0:
            d, slope = -g, -(g @ g)
        if -slope < tolerance**2:
            break
        step = min(step * 4, 1e3 / max(1e-12, np.abs(d).max()))
        while step > 1e-14:
            new = x + step * d
            v, h = energy(new)
            if v <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        turn = max(0.0, h @ (h - g) / max(1e-300, g @ g))
        x, value, d, g = new, v, -h + turn * d, h
    return x


def page_energy(comp: Component, alternative: bool = False, only: set[str] | None = None, boost: float = 1.0) -> Energy:
    """Same-language pages repel, each pair counted from both ends; with ``only``, those languages alone, ``boost`` times as strongly."""
    by: dict[str, list[int]] = {}
    for v, lang in enumerate(comp.langs):
        if only is None or lang in only:
            by.setdefault(lang, []).append(v)
    pairs = [(i, j) for own in by.values() for k, i in enumerate(own) for j in own[k + 1 :]]
    return Energy(len(comp.pages), comp.edges, pairs, PAGE_REST, 2.0 * boost, alternative)


def place_pages(comp: Component, seed: int = 0, alternative: bool = False, fast: bool = False) -> tuple[np.ndarray, float, float]:
    """(positions, energy before, energy after); ``fast`` takes the three most frequent languages, ten times as strongly, in at most 80 rounds."""
    only, boost, rounds = None, 1.0, 200
    if fast:
        count = pd.Series(comp.langs).value_counts()
        only = {lang for _, lang in sorted((-n, lang) for lang, n in count.items())[:3]}
        boost, rounds = 10.0, 80
    energy = page_energy(comp, alternative, only, boost)
    start = _rng(seed, comp.key).uniform(-SPAN, SPAN, 2 * len(comp.pages))
    end = descend(energy, start, rounds)
    return end.reshape(-1, 2), energy(start)[0], energy(end)[0]


def page_positions(pages: DataFrame, edges: DataFrame, member: DataFrame, seed: int = 0, alternative: bool = False, fast: bool = False, limit: int = LIMIT) -> DataFrame:
    """(root, page_id, x, y, z, before, after): z is 0; before and after are the component's energies."""

    def step(comp: Component) -> pd.DataFrame:
        at, before, after = place_pages(comp, seed, alternative, fast)
        return pd.DataFrame({"root": comp.key, "page_id": comp.pages, "x": at[:, 0], "y": at[:, 1], "z": 0.0, "before": before, "after": after})

    return per_component(pages, edges, member, step, "root string, page_id string, x double, y double, z double, before double, after double", limit)


def energy_at(pages: DataFrame, edges: DataFrame, positions: DataFrame, alternative: bool = False, limit: int = LIMIT) -> DataFrame:
    """(root, page_id, energy, gx, gy): the energy of each component at given positions (page_id, root, x, y), and its gradient at each page."""
    at = positions.join(pages.select(F.col("key").alias("page_id"), "lang"), "page_id").select("root", "page_id", "lang", "x", "y")
    of = positions.select(F.col("page_id").alias("a"), "root")
    e = edges.join(of, "a").select(F.col("root").alias("root"), "a", "b", "weight")  # a column of its own, as both sides come from positions

    def one(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if len(own) > limit:
            raise ValueError(f"component {own['root'].iloc[0]} has {len(own)} pages, more than {limit}")
        own = own.sort_values("page_id")
        comp = build(own["root"].iloc[0] if len(own) else "", own.rename(columns={"page_id": "key"}), links)
        value, g = page_energy(comp, alternative)(own[["x", "y"]].to_numpy(float).ravel())
        g = g.reshape(-1, 2)
        return pd.DataFrame({"root": comp.key, "page_id": comp.pages, "energy": value, "gx": g[:, 0], "gy": g[:, 1]})

    return at.groupBy("root").cogroup(e.groupBy("root")).applyInPandas(one, "root string, page_id string, energy double, gx double, gy double")


def timings(comp: Component, repeats: int = 50) -> float:
    """Milliseconds of one call of function and gradient, as a mean."""
    import time

    energy = page_energy(comp)
    x = np.random.default_rng(0).uniform(-SPAN, SPAN, 2 * len(comp.pages))
    began = time.perf_counter()
    for _ in range(repeats):
        energy(x)
    return (time.perf_counter() - began) * 1000 / repeats


# ---- meanings ----


def meaning_graph(pages: DataFrame, meanings: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((root, meaning, size, label), (root, m1, m2, n)): pages of each meaning that redirect nowhere, the title of its English one or else nothing, and edges between meanings."""
    own = pages.where("redirect_id is null").join(meanings.withColumnRenamed("page_id", "key"), "key")
    nodes = own.groupBy("root", "meaning").agg(F.count("*").alias("size"), F.coalesce(F.min(F.when(F.col("lang") == "en", F.col("title"))), F.lit("")).alias("label"))
    of = own.select("key", "meaning")
    cut = edges.join(of.select(F.col("key").alias("a"), F.col("meaning").alias("ma")), "a").join(own.select(F.col("key").alias("b"), F.col("meaning").alias("mb"), "root"), "b")
    links = cut.where("ma <> mb").groupBy("root", F.least("ma", "mb").alias("m1"), F.greatest("ma", "mb").alias("m2")).agg(F.count("*").alias("n"))
    return nodes, links


def meaning_inside(meanings: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, meaning, n): edges inside each meaning."""
    a, b = (meanings.select(F.col("page_id").alias(c), F.col("meaning").alias(f"m{c}"), F.col("root").alias(f"r{c}")) for c in "ab")
    return edges.join(a, "a").join(b, "b").where("ma = mb").groupBy(F.col("ra").alias("root"), F.col("ma").alias("meaning")).agg(F.count("*").alias("n"))


def skeleton_positions(nodes: DataFrame, links: DataFrame, seed: int = 0, rounds: int = 120, limit: int = LIMIT) -> DataFrame:
    """(root, meaning, x, y, before, after): meanings placed by springs along their links and repulsion between all pairs, at most ``limit`` meanings a component."""

    def one(own: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        if len(own) > limit:
            raise ValueError(f"component {own['root'].iloc[0]} has {len(own)} meanings, more than {limit}")
        names = sorted(own["meaning"])
        at = {m: i for i, m in enumerate(names)}
        edges = sorted((at[a], at[b], float(n)) for a, b, n in zip(edge["m1"], edge["m2"], edge["n"], strict=True))
        pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
        energy = Energy(len(names), edges, pairs, SKELETON_REST)
        root = own["root"].iloc[0] if len(own) else ""
        start = _rng(seed, root).uniform(-SPAN, SPAN, 2 * len(names))
        end = descend(energy, start, rounds)
        xy = end.reshape(-1, 2)
        return pd.DataFrame({"root": root, "meaning": names, "x": xy[:, 0], "y": xy[:, 1], "before": energy(start)[0], "after": energy(end)[0]})

    return nodes.groupBy("root").cogroup(links.groupBy("root")).applyInPandas(one, "root string, meaning string, x double, y double, before double, after double")


def centroids(meanings: DataFrame, positions: DataFrame) -> DataFrame:
    """(root, meaning, x, y): means over the pages that have a position."""
    return meanings.join(positions.select("page_id", "x", "y"), "page_id").groupBy("root", "meaning").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def bounding_box(positions: DataFrame, by: str = "root") -> DataFrame:
    return positions.groupBy(by).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
