"""What has to change in live links between pages so that they agree with a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guarded(members: DataFrame, live: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Members (cluster, lang, title) of clusters all of whose pages are live and no redirects; editions that are not active do not count.

    ``live``: (lang, title, is_redirect)."""
    own = members if active is None else members.join(active.select("lang").distinct(), "lang", "left_semi")
    state = own.join(live.select("lang", "title", "is_redirect"), ["lang", "title"], "left")
    bad = state.where(F.col("is_redirect").isNull() | F.col("is_redirect")).select("cluster").distinct()
    return own.join(bad, "cluster", "left_anti")


def changes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(cluster, lang, title, to_lang, action, target): what each page of a cluster is to add, change or remove.

    ``links``: (lang, title, to_lang, to_title) of live pages. A page never links to its own edition; of links that stay
    nothing is said. target is the page that should be linked, null where a link goes."""
    a, b = members.alias("a"), members.alias("b")
    desired = a.join(b, F.col("a.cluster") == F.col("b.cluster")).select("a.cluster", "a.lang", "a.title", F.col("b.lang").alias("to_lang"), F.col("b.title").alias("target"))
    page = members.select("cluster", "lang", "title")
    actual = page.join(links, ["lang", "title"]).select("cluster", "lang", "title", "to_lang", F.col("to_title"))
    both = desired.join(actual, ["cluster", "lang", "title", "to_lang"], "full")
    own = F.col("to_lang") == F.col("lang")
    action = F.when(F.col("target").isNull(), "remove").when(F.col("to_title").isNull() & ~own, "add").when(F.col("to_title").isNotNull() & (F.col("to_title") != F.col("target")), "change")
    return both.withColumn("action", action).where("action is not null").select("cluster", "lang", "title", "to_lang", "action", "target")


def summaries(found: DataFrame) -> DataFrame:
    """(lang, title, summary): the edit summary of each page that changes."""
    part = lambda a: F.array_sort(F.collect_list(F.when(F.col("action") == a, F.col("to_lang"))))
    g = found.groupBy("lang", "title").agg(part("add").alias("add"), part("change").alias("change"), part("remove").alias("remove"))
    said = [F.when(F.size(c) > 0, F.concat(F.lit(f" {w}: ("), F.array_join(c, ", "), F.lit(")"))) for c, w in (("add", "adding"), ("change", "changing"), ("remove", "removing"))]
    return g.select("lang", "title", F.concat(F.lit("Interwiki analysis"), F.concat_ws(",", *said)).alias("summary"))
