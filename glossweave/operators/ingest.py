"""Dump records into the link graph: filters, look-ups by title, and reasons for what is turned away.

Each step returns (accepted, rejected); rejected rows carry ``reason``, or are left out where the rule says silently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.sources.schema import ARTICLE, CATEGORY

KEPT = (ARTICLE, CATEGORY)


def _split(df: DataFrame, reason, columns: list) -> tuple[DataFrame, DataFrame]:
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").select(*columns), judged.where("reason is not null")


def pages(records: DataFrame) -> DataFrame:
    """(key, lang, namespace, title, redirect_id) of the records (lang, page_id, namespace, title) in kept namespaces."""
    ns = F.col("namespace").cast("int")
    return records.where(ns.isin(*KEPT)).select(F.concat("lang", F.lit(":"), "page_id").alias("key"), "lang", ns.alias("namespace"), "title", F.lit(None).cast("string").alias("redirect_id"))


def titles(all_pages: DataFrame) -> DataFrame:
    """(lang, namespace, title, key): one page for each title; of several the smallest key."""
    return all_pages.groupBy("lang", "namespace", "title").agg(F.min("key").alias("key"))


def page_key(all_pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (lang, namespace, title) with the key found, or null."""
    return wanted.join(titles(all_pages), ["lang", "namespace", "title"], "left")


def page_by_key(all_pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (key) with the page's columns, or nulls."""
    return wanted.join(all_pages, "key", "left")


def redirects(all_pages: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, redirect_id) from records (lang, from_id, namespace, title): the source exists, and the title in its namespace and language."""
    ns = F.col("namespace").cast("int")
    asked = records.where(ns.isin(*KEPT)).select(F.concat("lang", F.lit(":"), "from_id").alias("key"), "lang", ns.alias("namespace"), "title")
    source = all_pages.select("key", F.col("namespace").alias("own"))
    found = asked.join(source, "key", "left").join(titles(all_pages).withColumnRenamed("key", "redirect_id"), ["lang", "namespace", "title"], "left")
    reason = F.when(F.col("own").isNull(), "nonexistent source").when(F.col("own") != F.col("namespace"), "cross-namespace").when(F.col("redirect_id").isNull(), "nonexistent target")
    return _split(found, reason, ["key", "redirect_id"])


def with_redirects(all_pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with their redirect_id set from (key, redirect_id); a page with several keeps the last by order, the largest."""
    one = found.groupBy("key").agg(F.max("redirect_id").alias("__to"))
    return all_pages.join(one, "key", "left").withColumn("redirect_id", F.coalesce("__to", "redirect_id")).drop("__to")


def remove_double_redirects(all_pages: DataFrame, policy: str = "middle") -> DataFrame:
    """Pages without chains of redirects, all decided at once on the input.

    ``middle``: a page that redirects and is redirected to loses its redirect. ``source``: a page that redirects to one
    that redirects loses its own."""
    r = all_pages.where("redirect_id is not null").select("key", "redirect_id")
    if policy == "middle":
        hit = r.join(r.select(F.col("redirect_id").alias("key")).distinct(), "key", "left_semi").select("key")
    elif policy == "source":
        hit = r.join(r.select(F.col("key").alias("redirect_id")), "redirect_id", "left_semi").select("key")
    else:
        raise ValueError(f"no such policy: {policy}")
    return all_pages.join(hit.withColumn("__hit", F.lit(True)), "key", "left").withColumn("redirect_id", F.when(F.col("__hit"), None).otherwise(F.col("redirect_id"))).drop("__hit")


def langlinks(all_pages: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src_id, dst_id) from records (lang, from_id, to_lang, title): links between languages, from pages that are no redirects.

    The target has the source's namespace; of titles outside articles what stands up to the first colon goes, and a title
    without one is empty. The target may be a redirect. Sources that do not exist are left out silently."""
    asked = records.select(F.concat("lang", F.lit(":"), "from_id").alias("key"), "lang", "to_lang", "title")
    source = all_pages.select("key", F.col("namespace").alias("namespace"), F.col("redirect_id").alias("__redirect"))
    found = asked.join(source, "key", "left")
    colon = F.instr("title", ":")
    bare = F.when(F.col("namespace") == ARTICLE, F.col("title")).when(colon > 0, F.substring(F.col("title"), colon + 1, F.length("title"))).otherwise("")
    target = titles(all_pages).select(F.col("lang").alias("to_lang"), "namespace", F.col("title").alias("bare"), F.col("key").alias("dst_id"))
    found = found.withColumn("bare", bare).join(target, ["to_lang", "namespace", "bare"], "left")
    reason = (
        F.when(F.col("lang") == F.col("to_lang"), "same language").when(F.col("namespace").isNull(), "silent")
        .when(F.col("__redirect").isNotNull(), "redirect source").when(F.col("dst_id").isNull(), "nonexistent target")
    )
    ok, bad = _split(found, reason, [F.col("key").alias("src_id"), "dst_id"])
    return ok, bad.where("reason <> 'silent'")


def pagelinks(all_pages: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src_id, dst_id) from records (lang, from_id, namespace, title): source and title exist in the language."""
    ns = F.col("namespace").cast("int")
    asked = records.select(F.concat("lang", F.lit(":"), "from_id").alias("key"), "lang", ns.alias("namespace"), "title")
    return _linked(all_pages, asked, "src_id", "dst_id")


def categorylinks(all_pages: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_id, category_id) from records (lang, from_id, title): the category of that title exists in the language."""
    asked = records.select(F.concat("lang", F.lit(":"), "from_id").alias("key"), "lang", F.lit(CATEGORY).alias("namespace"), "title")
    return _linked(all_pages, asked, "page_id", "category_id")


def _linked(all_pages: DataFrame, asked: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    there = all_pages.select("key", F.lit(True).alias("__there"))
    found = asked.join(there, "key", "left").join(titles(all_pages).withColumnRenamed("key", target), ["lang", "namespace", "title"], "left")
    reason = F.when(F.col("__there").isNull(), "nonexistent source").when(F.col(target).isNull(), "nonexistent target")
    return _split(found, reason, [F.col("key").alias(source), target])


def rejects(*rejected: DataFrame) -> DataFrame:
    """(step, reason, n) of rejected rows of several steps, in their order."""
    counted = [r.groupBy("reason").agg(F.count("*").alias("n")).withColumn("step", F.lit(k)) for k, r in enumerate(rejected)]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out.select("step", "reason", "n")


def import_graph(records: dict[str, DataFrame], policy: str = "middle", with_pagelinks: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda pages: pages) -> dict[str, DataFrame]:
    """pages, langlinks, categorylinks (and pagelinks) of all languages in one plan, and the rejected rows of each step.

    One policy for chains of redirects holds for the pages and for what counts as a link's source. ``keep`` may store the
    pages, which all later steps read."""
    p = pages(records["page"])
    moved, bad_redirects = redirects(p, records["redirect"])
    p = keep(remove_double_redirects(with_redirects(p, moved), policy))
    links, bad_links = langlinks(p, records["langlinks"])
    cats, bad_cats = categorylinks(p, records["categorylinks"])
    out = {"pages": p, "langlinks": links, "categorylinks": cats, "rejected_redirects": bad_redirects, "rejected_langlinks": bad_links, "rejected_categorylinks": bad_cats}
    if with_pagelinks:
        out["pagelinks"], out["rejected_pagelinks"] = pagelinks(p, records["pagelinks"])
    return out


def title_prefix(all_pages: DataFrame, prefix: str) -> DataFrame:
    """Pages whose upper-cased title begins with the upper-cased prefix."""
    return all_pages.where(F.upper("title").startswith(prefix.upper()))


def top_languages(members: DataFrame, k: int = 3) -> DataFrame:
    """(comp, lang, n): the k most frequent languages of each component, ties to the smaller name."""
    n = members.groupBy("comp", "lang").agg(F.count("*").alias("n"))
    w = Window.partitionBy("comp").orderBy(F.desc("n"), "lang")
    return n.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")
