"""Splitting components into clusters in which no language has two pages, at a small weight of cut edges.

A cluster step is a function of one component's pages and edges, run for all components by ``applyInPandas`` over its rows;
greedy folds also exist as native higher-order expressions. Components beyond ``limit`` pages are refused, as one group
is one task: choose a size class, or raise the limit. Ties are decided by page keys, so results do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 10_000


class Clusters:
    """Clusters of vertices with the languages of each; two merge only if their languages differ."""

    def __init__(self, langs: list):
        self.of = list(range(len(langs)))
        self.members = {i: [i] for i in range(len(langs))}
        self.langs = {i: {l} for i, l in enumerate(langs)}

    def mergeable(self, i: int, j: int) -> bool:
        return i != j and self.langs[i].isdisjoint(self.langs[j])

    def merge(self, i: int, j: int, force: bool = False) -> None:
        if i == j:
            return
        if not force and not self.mergeable(i, j):
            raise ValueError("clusters share a language")
        for v in self.members[j]:
            self.of[v] = i
        self.members[i] += self.members.pop(j)
        self.langs[i] |= self.langs.pop(j)

    def add(self, edges: Iterable[tuple[int, int, float]]) -> list[int]:
        """Merges along edges in order; gives the positions of those whose clusters could not."""
        cut = []
        for k, (a, b, _) in enumerate(edges):
            i, j = self.of[a], self.of[b]
            if i != j:
                if self.langs[i].isdisjoint(self.langs[j]):
                    self.merge(i, j)
                else:
                    cut.append(k)
        return cut


@dataclass
class Component:
    """One component: page keys in order, their languages, and edges (a, b, weight) by vertex number, in order of keys."""

    key: str
    pages: list[str]
    langs: list[str]
    edges: list[tuple[int, int, float]]
    x: dict = field(default_factory=dict)

    def weight(self, of: list[int]) -> float:
        return sum(w for a, b, w in self.edges if of[a] != of[b])

    def recluster(self, cut: set[int], force: bool = True) -> Clusters:
        """Clusters that all edges but those of the cut make."""
        c = Clusters(self.langs)
        for k, (a, b, _) in enumerate(self.edges):
            if k not in cut:
                c.merge(c.of[a], c.of[b], force)
        return c


def greedy(comp: Component, order: Iterable[int]) -> tuple[Clusters, float]:
    """Clusters by merging along edges in the given order, and the weight of edges between clusters."""
    c = Clusters(comp.langs)
    c.add([comp.edges[k] for k in order])
    return c, comp.weight(c.of)


def find_cut(comp: Component, order: list[int]) -> tuple[set[int], Clusters]:
    """The edges, by number, that conflict when they are met in this order."""
    c = Clusters(comp.langs)
    return {order[k] for k in c.add([comp.edges[e] for e in order])}, c


def edge_betweenness(n: int, edges: list[tuple[int, int, float]], ignored: set[int] = frozenset(), sources: Iterable[int] | None = None) -> np.ndarray:
    """Of each edge, the shortest paths from all sources that pass it, in shares where several are shortest; ignored edges have 0."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (a, b, _) in enumerate(edges):
        if k not in ignored:
            near[a].append((b, k))
            near[b].append((a, k))
    out = np.zeros(len(edges))
    for s in range(n) if sources is None else sources:
        level, paths, seen = {s: 0}, {s: 1.0}, [s]
        for v in seen:  # grows while it is walked
            for w, _ in near[v]:
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0.0
                    seen.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        flow = dict.fromkeys(seen, 1.0)
        for v in reversed(seen):
            for u, k in near[v]:
                if level[u] == level[v] - 1:
                    share = flow[v] * paths[u] / paths[v]
                    out[k] += share
                    flow[u] += share
    return out


def by_betweenness(comp: Component, seed: int = 0) -> tuple[list[int], float]:
    eb = edge_betweenness(len(comp.pages), comp.edges)
    c, cost = greedy(comp, np.lexsort((np.arange(len(eb)), np.round(eb, 9))).tolist())
    return c.of, cost


def newman_girvan(comp: Component, seed: int = 0) -> tuple[list[int], float]:
    """Takes out the edge of largest betweenness until no cluster has a language twice, then merges back along what was taken, in order."""
    removed: list[int] = []
    gone: set[int] = set()
    scope: Iterable[int] = range(len(comp.pages))
    clusters = comp.recluster(gone)
    while len(removed) < len(comp.edges):
        eb = np.round(edge_betweenness(len(comp.pages), comp.edges, gone, scope), 9)
        last = max((k for k in range(len(eb)) if k not in gone), key=lambda k: (eb[k], k))
        removed.append(last)
        gone.add(last)
        clusters = comp.recluster(gone)
        scope = [v for i, own in sorted(clusters.members.items()) for v in own if len(own) > len(clusters.langs[i])]
        if not scope:
            break
    clusters.add([comp.edges[k] for k in removed])
    return clusters.of, comp.weight(clusters.of)


def randomly(comp: Component, seed: int = 0, repeats: int = 10) -> list[float]:
    """Costs of greedy merging along edges in random orders."""
    rng = _rng(seed, comp.key)
    return [greedy(comp, rng.permutation(len(comp.edges)).tolist())[1] for _ in range(repeats)]


def _rng(seed: int, key: str) -> np.random.Generator:
    return np.random.default_rng([seed, *key.encode()])


@dataclass
class Genetic:
    """Sizes and chances of the genetic search."""

    generation: int = 100
    fresh: int = 10
    mutation: float = 0.05
    patience: int = 5

    def __call__(self, comp: Component, seed: int = 0) -> tuple[list[int], float]:
        best, _ = self.search(comp, seed)
        of = comp.recluster(best).of
        return of, comp.weight(of)

    def search(self, comp: Component, seed: int = 0) -> tuple[set[int], list[float]]:
        """(the best cut, the best fitness after each generation)."""
        rng, n = _rng(seed, comp.key), len(comp.edges)

        def fitness(cut: set[int]) -> float:
            return 1 / (1 + np.sqrt(sum(comp.edges[k][2] for k in cut)))

        def fresh() -> set[int]:
            return find_cut(comp, rng.permutation(n).tolist())[0]

        def child(one: set[int], two: set[int]) -> set[int]:
            either = sorted(one | two)
            order = [k for k in range(n) if k not in one and k not in two] + [either[k] for k in rng.permutation(len(either))]
            if n > 2 and rng.random() < self.mutation:
                i, j = rng.choice(n, 2, replace=False)
                order[i], order[j] = order[j], order[i]
            return find_cut(comp, order)[0]

        people = [fresh() for _ in range(self.generation)]
        best, top, history, age = set(range(n)), -1.0, [], 0
        while age < self.patience:
            age += 1
            fit = np.array([fitness(p) for p in people])
            k = int(fit.argmax())
            if fit[k] > top:
                best, top, age = people[k], float(fit[k]), 0
            history.append(top)
            share = np.cumsum(fit) / fit.sum()
            parents = [people[min(i, len(people) - 1)] for i in np.searchsorted(share, rng.random(self.generation - self.fresh))] + [fresh() for _ in range(self.fresh)]
            people = [child(*pair) for a, b in zip(parents[::2], parents[1::2], strict=False) for pair in ((a, b), (b, a))]
        return best, history


def cliques(comp: Component, seed: int = 0, phases: tuple[tuple[int, str], ...] = ((5, "heaviest"), (2, "closest"))) -> tuple[list[int], float]:
    """Merges groups of clusters that are all linked with each other and share no language, first large ones, then pairs.

    A group starts at the heaviest cluster that has not failed, and grows by the heaviest candidate, or by the one of the
    largest weight to the group. Ties go to the cluster with the smallest page key."""
    c = Clusters(comp.langs)
    for least, by in phases:
        failed: set[int] = set()
        while True:
            link: dict[int, dict[int, float]] = {i: {} for i in c.members}
            for a, b, w in comp.edges:
                i, j = c.of[a], c.of[b]
                if i != j:
                    link[i][j] = link[i].get(j, 0.0) + w
                    link[j][i] = link[j].get(i, 0.0) + w
            total = {i: sum(l.values()) for i, l in link.items()}
            name = {i: min(own) for i, own in c.members.items()}
            # a group that fails leaves the clusters, and so these sums, as they are
            while (start := min((i for i in total if i not in failed), key=lambda i: (-total[i], name[i]), default=None)) is not None:
                group, langs, possible, now = [], set(), set(total) - failed, start
                while now is not None:
                    group.append(now)
                    langs |= c.langs[now]
                    possible &= link[now].keys()
                    fit = [i for i in possible if langs.isdisjoint(c.langs[i])]
                    rank = total.__getitem__ if by == "heaviest" else lambda i: sum(link[i][g] for g in group)  # noqa: B023
                    now = min(fit, key=lambda i: (-rank(i), name[i]), default=None)
                if len(group) >= least:
                    break
                failed.add(start)
            if start is None:
                break
            for other in group[1:]:
                c.merge(group[0], other)
            failed &= c.members.keys()
    return c.of, comp.weight(c.of)


ENGINES: dict[str, Callable[..., tuple[list[int], float]]] = {
    "analysis.betweenness": by_betweenness,
    "analysis.newman-girvan": newman_girvan,
    "analysis.genetic": Genetic(),
    "analysis.cliques": cliques,
}


def build(key: str, pages: pd.DataFrame, edges: pd.DataFrame) -> Component:
    """From rows (key, lang) and (a, b, weight); edges of pages that are not there are left out."""
    pages = pages.drop_duplicates("key").sort_values("key")
    at = {k: i for i, k in enumerate(pages["key"])}
    rows = sorted((a, b, w) for a, b, w in zip(edges["a"], edges["b"], edges["weight"], strict=True) if a in at and b in at and a != b)
    return Component(key, list(pages["key"]), list(pages["lang"]), [(at[a], at[b], float(w)) for a, b, w in rows])


def per_component(pages: DataFrame, edges: DataFrame, member: DataFrame, step: Callable[[Component], pd.DataFrame], schema: str, limit: int = LIMIT) -> DataFrame:
    """``step`` of every component: pages (key, lang, redirect_id), edges (a, b, weight), member (key, root)."""
    p = pages.where("redirect_id is null").join(member, "key").select("root", "key", "lang")
    e = edges.join(member.withColumnRenamed("key", "a"), "a").select(F.col("root").alias("root"), "a", "b", "weight")  # a column of its own, as both sides come from ``member``

    def one(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if len(own) > limit:
            raise ValueError(f"component {own['root'].iloc[0]} has {len(own)} pages, more than {limit}")
        if not len(own):
            return step(Component("", [], [], [])).iloc[:0]
        return step(build(own["root"].iloc[0], own, links))

    return p.groupBy("root").cogroup(e.groupBy("root")).applyInPandas(one, schema)


def clusters(pages: DataFrame, edges: DataFrame, member: DataFrame, auth: str, seed: int = 0, limit: int = LIMIT) -> DataFrame:
    """(root, key, cluster, cost) of one engine; a cluster is named by its smallest page key."""
    engine = ENGINES[auth]

    def step(comp: Component) -> pd.DataFrame:
        of, cost = engine(comp, seed) if comp.pages else ([], 0.0)
        name: dict[int, str] = {}
        for v, i in enumerate(of):
            name.setdefault(i, comp.pages[v])
        return pd.DataFrame({"root": comp.key, "key": comp.pages, "cluster": [name[i] for i in of], "cost": float(cost)})

    return per_component(pages, edges, member, step, "root string, key string, cluster string, cost double", limit)


def betweenness(pages: DataFrame, edges: DataFrame, member: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(root, a, b, eb) of all canonical edges."""

    def step(comp: Component) -> pd.DataFrame:
        eb = edge_betweenness(len(comp.pages), comp.edges)
        return pd.DataFrame({"root": comp.key, "a": [comp.pages[a] for a, _, _ in comp.edges], "b": [comp.pages[b] for _, b, _ in comp.edges], "eb": eb})

    return per_component(pages, edges, member, step, "root string, a string, b string, eb double", limit)


# ---- greedy folds as native expressions ----


#: Pages of a component that the native fold takes at most; ``greedy`` takes larger ones.
FOLD_LIMIT = 300


def models(pages: DataFrame, edges: DataFrame, member: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(root, pages, links) of components, refused beyond ``limit`` pages: arrays of (k, l) and (a, b, w) in order of keys."""
    p = pages.where("redirect_id is null").join(member, "key").groupBy("root").agg(F.array_sort(F.collect_list(F.struct(F.col("key").alias("k"), F.col("lang").alias("l")))).alias("pages"))
    e = edges.join(member.withColumnRenamed("key", "a"), "a").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("a", "b", F.col("weight").alias("w")))).alias("links"))
    refused = F.raise_error(F.concat(F.lit("component "), "root", F.lit(" has "), F.size("pages").cast("string"), F.lit(f" pages, more than {limit}")))
    return p.withColumn("pages", F.when(F.size("pages") <= limit, F.col("pages")).otherwise(refused)).join(e, "root")


def fold(pages: Column, links: Column) -> Column:
    """Greedy merging along an array of links (a, b, w): struct(nodes array<struct<k, l, c>>, cost); c numbers a cluster."""
    start = F.struct(F.transform(pages, lambda x, i: F.struct(x["k"].alias("k"), x["l"].alias("l"), i.alias("c"))).alias("nodes"), F.lit(0.0).alias("cost"))

    def cluster(nodes: Column, key: Column) -> Column:
        return F.filter(nodes, lambda n: n["k"] == key)[0]["c"]

    def langs(nodes: Column, c: Column) -> Column:
        return F.transform(F.filter(nodes, lambda n: n["c"] == c), lambda n: n["l"])

    def step(state: Column, e: Column) -> Column:
        nodes = state["nodes"]
        i, j = cluster(nodes, e["a"]), cluster(nodes, e["b"])
        clash = F.arrays_overlap(langs(nodes, i), langs(nodes, j))
        joined = F.transform(nodes, lambda n: F.struct(n["k"].alias("k"), n["l"].alias("l"), F.when(n["c"] == j, i).otherwise(n["c"]).alias("c")))
        return F.when(i == j, state).when(clash, F.struct(nodes.alias("nodes"), (state["cost"] + e["w"]).alias("cost"))).otherwise(F.struct(joined.alias("nodes"), state["cost"].alias("cost")))

    return F.aggregate(links, start, step)


def folded(df: DataFrame, keep: list[str], fold_limit: int) -> DataFrame:
    """(keep, nodes, cost) of greedy merging along ``keyed``: by ``fold`` up to ``fold_limit`` pages, by ``greedy`` beyond."""
    node = "array<struct<k:string,l:string,c:int>>"
    native = df.where(F.size("pages") <= fold_limit).withColumn("f", fold(F.col("pages"), F.col("keyed")))

    def large(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                keys, langs = [n["k"] for n in row["pages"]], [n["l"] for n in row["pages"]]
                at = {k: i for i, k in enumerate(keys)}
                edges = [(at[e["a"]], at[e["b"]], float(e["w"])) for e in row["keyed"] if e["a"] in at and e["b"] in at]
                own, cost = greedy(Component("", keys, langs, edges), range(len(edges)))
                nodes = [{"k": k, "l": l, "c": c} for k, l, c in zip(keys, langs, own.of, strict=True)]
                yield pd.DataFrame({**{c: [row[c]] for c in keep}, "nodes": [nodes], "cost": [float(cost)]})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    beyond = df.where(F.size("pages") > fold_limit).select(*keep, "pages", F.transform("keyed", lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), e["w"].cast("double").alias("w"))).alias("keyed"))
    beyond = beyond.mapInPandas(large, f"{kinds}, nodes {node}, cost double")
    return native.select(*keep, F.col("f.nodes").cast(node).alias("nodes"), F.col("f.cost").alias("cost")).unionByName(beyond)


def random_costs(model: DataFrame, repeats: int = 10, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """(root, seed, nodes, cost): greedy merging in pseudo-random orders, by the MD5 of seed and edge, so any engine has the same."""
    seeds = model.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("seed"))
    keyed = F.array_sort(F.transform("links", lambda e: F.struct(F.md5(F.concat_ws("|", F.col("seed").cast("string"), e["a"], e["b"])).alias("h"), e["a"].alias("a"), e["b"].alias("b"), e["w"].alias("w"))))
    return folded(seeds.withColumn("keyed", keyed), ["root", "seed"], fold_limit)


def spatial(model: DataFrame, positions: DataFrame, member: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """(root, nodes, cost): greedy merging along edges in order of the distance between their pages."""
    at = positions.join(member, positions["page_id"] == member["key"]).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("page_id", F.struct("x", "y", "z")))).alias("at"))

    def far(e: Column) -> Column:
        p, q = F.col("at")[e["a"]], F.col("at")[e["b"]]
        return sum((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz")

    keyed = F.array_sort(F.transform("links", lambda e: F.struct(far(e).alias("d"), e["a"].alias("a"), e["b"].alias("b"), e["w"].alias("w"))))
    return folded(model.join(at, "root").withColumn("keyed", keyed), ["root"], fold_limit)


def named(found: DataFrame) -> DataFrame:
    """(root, key, cluster, cost) from (root, nodes, cost); a cluster is named by its smallest page key."""
    rows = found.select("root", "cost", F.explode("nodes").alias("x")).select("root", "cost", F.col("x.k").alias("key"), F.col("x.c").alias("c"))
    return rows.join(rows.groupBy("root", "c").agg(F.min("key").alias("cluster")), ["root", "c"]).select("root", "key", "cluster", "cost")


def validity(found: DataFrame, pages: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """(root, n_pages, conflicts, cost_gap, mergeable) of clusters (root, key, cluster, cost): languages that clusters have twice,
    the reported less the counted weight of edges between clusters, and linked clusters that share no language and so could be one."""
    langs = found.join(pages.select("key", "lang"), "key").groupBy("root", "cluster", "lang").agg(F.count("*").alias("n"))
    clash = langs.groupBy("root").agg(F.sum("n").alias("n_pages"), F.sum(F.col("n") - 1).alias("conflicts"))
    of = found.select("key", "cluster")
    cut = edges.join(of.withColumnRenamed("key", "a").withColumnRenamed("cluster", "ca"), "a").join(of.withColumnRenamed("key", "b").withColumnRenamed("cluster", "cb"), "b")
    cut = cut.join(member.withColumnRenamed("key", "a"), "a").where("ca <> cb")
    cost = cut.groupBy("root").agg(F.sum("weight").alias("counted"))
    own = langs.select("root", "cluster", "lang")
    pairs = cut.select("root", "ca", "cb").distinct()
    shared = pairs.join(own.withColumnRenamed("cluster", "ca"), ["root", "ca"]).join(own.withColumnRenamed("cluster", "cb"), ["root", "cb", "lang"]).select("root", "ca", "cb").distinct()
    free = pairs.join(shared, ["root", "ca", "cb"], "left_anti").groupBy("root").agg(F.count("*").alias("mergeable"))
    told = found.groupBy("root").agg(F.max("cost").alias("cost"))
    out = clash.join(told, "root").join(cost, "root", "left").join(free, "root", "left")
    return out.select("root", "n_pages", "conflicts", F.round(F.abs(F.col("cost") - F.coalesce("counted", F.lit(0.0))), 6).alias("cost_gap"), F.coalesce("mergeable", F.lit(0).cast("long")).alias("mergeable"))
