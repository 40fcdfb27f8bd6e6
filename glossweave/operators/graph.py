"""Components of the link graph, their selection, and their model: canonical edges and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.keys import DNS, OID, URL, uuid5
from glossweave.operators.components import connected_components


def membership(pages: DataFrame, langlinks: DataFrame) -> DataFrame:
    """(key, root) of all pages: the smallest page key that language links and redirects lead to, whatever their direction; a page without either is its own."""
    edges = langlinks.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).union(pages.where("redirect_id is not null").select("key", "redirect_id"))
    found = connected_components(edges).withColumnRenamed("id", "key")
    return pages.select("key").join(found, "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def components(pages: DataFrame, member: DataFrame, drop_singletons: bool = True, langlinks: DataFrame | None = None) -> DataFrame:
    """(root, namespace, coherent, size, n_langs, n_pages) of each component.

    size counts pages that redirect nowhere; with ``drop_singletons`` a component of size 1 is left out, one of size 0 is not.
    coherent: no language has two such pages. The namespace is that of the smallest key. With ``langlinks``, components that
    no language link touches are left out (isolated pages then belong to none)."""
    own = pages.join(member, "key")
    by_lang = own.groupBy("root", "lang").agg(
        F.count_if(F.col("redirect_id").isNull()).alias("n"), F.count("*").alias("all"),
        F.min(F.struct("key", "namespace")).alias("first"),
    )
    out = by_lang.groupBy("root").agg(
        F.min("first").getField("namespace").alias("namespace"), (F.max("n") <= 1).alias("coherent"), F.sum("n").cast("int").alias("size"),
        F.count_if(F.col("n") > 0).cast("int").alias("n_langs"), F.sum("all").cast("int").alias("n_pages"),
    )
    if drop_singletons:
        out = out.where("size <> 1")
    if langlinks is not None:
        touched = langlinks.select(F.col("src_id").alias("key")).join(member, "key").select("root").distinct()
        out = out.join(touched, "root", "left_semi")
    return out


def component_keys(member: DataFrame, scheme: str = "oid") -> DataFrame:
    """(root, comp_id): version-5 UUIDs of all page keys in order: joined by ``#`` (``oid``) or by nothing in the DNS name space (``dns``)."""
    names = member.groupBy("root").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    ns, sep = (OID, "#") if scheme == "oid" else (DNS, "")
    return names.select("root", uuid5(ns, F.array_join("keys", sep)).alias("comp_id"))


def saved(pages: DataFrame, langlinks: DataFrame, member: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, pages, langlinks) as they are stored: by comp_id; links belong to their source's component."""
    ids = component_keys(member.join(comps, "root", "left_semi"))
    key = member.join(ids, "root").select("key", "comp_id")
    stored = comps.join(ids, "root").select(F.col("comp_id").alias("key"), "namespace", "coherent", "size")
    p = pages.drop("comp_id").join(key, "key", "left")
    l = langlinks.drop("comp_id").join(key.withColumnRenamed("key", "src_id"), "src_id", "left")
    return stored, p, l


# Sizes of the classes.
SIZE_CLASSES = {"small": (3, 300), "medium": (301, 1000), "big": (1001, 10000), "huge": (10001, None)}


def incoherent(comps: DataFrame, lowest: int | None = None, highest: int | None = None) -> DataFrame:
    """Components with a language that has two pages, of a size in between; either bound may be left out, and 0 is a bound."""
    out = comps.where("not coherent")
    if lowest is not None:
        out = out.where(F.col("size") >= lowest)
    return out.where(F.col("size") <= highest) if highest is not None else out


def size_classes(comps: DataFrame, classes: dict[str, tuple[int, int | None]] = SIZE_CLASSES) -> DataFrame:
    """(class, n, pages) over incoherent components; sizes outside all classes do not count."""
    name = F.lit(None).cast("string")
    for k, (lo, hi) in classes.items():
        name = F.when((F.col("size") >= lo) & (F.lit(True) if hi is None else F.col("size") <= hi), k).otherwise(name)
    return incoherent(comps).withColumn("class", name).where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("pages"))


def select(comps: DataFrame, keys: list[str], column: str = "root") -> DataFrame:
    return comps.where(F.col(column).isin(keys))


# ---- the model of a component ----


def occurrences(pages: DataFrame, langlinks: DataFrame) -> DataFrame:
    """(src_id, a, b, redirected) of every link: its destination replaced by what that redirects to, ends in order."""
    to = pages.where("redirect_id is not null").select(F.col("key").alias("dst_id"), "redirect_id")
    end = F.coalesce("redirect_id", "dst_id")
    return langlinks.join(to, "dst_id", "left").select("src_id", F.least("src_id", end).alias("a"), F.greatest("src_id", end).alias("b"), F.col("redirect_id").isNotNull().alias("redirected"))


def edges(pages: DataFrame, langlinks: DataFrame, direct: float = 1.0, redirected: float = 0.1) -> DataFrame:
    """(a, b, n_direct, n_redirect, weight): canonical edges; every occurrence of a link adds to the weight."""
    out = occurrences(pages, langlinks).groupBy("a", "b").agg(F.count_if(~F.col("redirected")).alias("n_direct"), F.count_if("redirected").alias("n_redirect"))
    return out.withColumn("weight", F.col("n_direct") * direct + F.col("n_redirect") * redirected)


def common(pairs: DataFrame, owned: DataFrame, links: DataFrame, owner: str, item: str) -> DataFrame:
    """(a, b, n): how many different items of b some link leads to from an item of a; pairs without any are left out."""
    of_a = owned.select(F.col(owner).alias("a"), F.col(item).alias("src_id"))
    of_b = owned.select(F.col(owner).alias("b"), F.col(item).alias("dst_id"))
    hop = pairs.select("a", "b").distinct().join(of_a, "a").join(links.select("src_id", "dst_id").distinct(), "src_id").join(of_b, ["b", "dst_id"])
    return hop.groupBy("a", "b").agg(F.countDistinct("dst_id").alias("n"))


def common_categories(pairs: DataFrame, categorylinks: DataFrame, langlinks: DataFrame) -> DataFrame:
    return common(pairs, categorylinks, langlinks, "page_id", "category_id")


def common_links(pairs: DataFrame, pagelinks: DataFrame, langlinks: DataFrame) -> DataFrame:
    return common(pairs, pagelinks, langlinks, "src_id", "dst_id")


def weighted(base: DataFrame, categories: DataFrame | None = None, links: DataFrame | None = None, unit: bool = False) -> DataFrame:
    """Edges with the bonus of common categories (0.8 * sqrt(n)) and of common links (0.2 * ln(1 + n)); ``unit`` makes every weight 1 and every count 0."""
    out = base.withColumn("n_categories", F.lit(0).cast("long"))
    if categories is not None:
        out = out.drop("n_categories").join(categories.withColumnRenamed("n", "n_categories"), ["a", "b"], "left").fillna(0, ["n_categories"])
        out = out.withColumn("weight", F.col("weight") + 0.8 * F.sqrt("n_categories"))
    if links is not None:
        out = out.join(links.withColumnRenamed("n", "n_links"), ["a", "b"], "left").fillna(0, ["n_links"])
        out = out.withColumn("weight", F.col("weight") + 0.2 * F.log1p("n_links"))
    return out.withColumn("weight", F.lit(1.0)).withColumn("n_categories", F.lit(0).cast("long")) if unit else out


def stats(pages: DataFrame, member: DataFrame, edge: DataFrame) -> DataFrame:
    """(root, n_pages, n_links): pages that redirect nowhere and canonical edges of each component."""
    p = pages.where("redirect_id is null").join(member, "key").groupBy("root").agg(F.count("*").alias("n_pages"))
    e = edge.join(member, edge["a"] == member["key"]).groupBy("root").agg(F.count("*").alias("n_links"))
    return p.join(e, "root", "full").fillna(0, ["n_pages", "n_links"])


def meanings(pages: DataFrame, clusters: DataFrame) -> DataFrame:
    """(page_id, meaning) from clusters (key, root, cluster) of pages that redirect nowhere.

    Redirects join what they lead to; a meaning is the version-5 UUID of its page keys in order, joined by a space."""
    own = clusters.select("key", "root", "cluster")
    also = pages.where("redirect_id is not null").select(F.col("key").alias("__key"), F.col("redirect_id").alias("key")).join(own, "key").select(F.col("__key").alias("key"), "root", "cluster")
    every = own.union(also)
    names = every.groupBy("root", "cluster").agg(uuid5(URL, F.array_join(F.array_sort(F.collect_list("key")), " ")).alias("meaning"))
    return every.join(names, ["root", "cluster"]).select(F.col("key").alias("page_id"), "meaning", "root")
