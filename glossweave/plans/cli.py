"""The command line: import dumps, find components, cluster, lay out, draw and export, over tables in a folder.

    python -m glossweave.plans.cli -d STORE -u USER -i DUMPS -o OUT -s common-cats,medium-only -r import,find-comps,genetic,serialize

Commands run in the order given; unknown ones are passed over. With ``-H`` (and ``-P``, ``-p``) pages and links are read
from the database ``-d`` of that host (and port, with that password); with a JDBC URL as ``-d``, from there. ``reconcile``
compares the partitions under ``-f`` with live links (see ``Session.reconcile``); ``-n`` only tells what would change.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.session import stored
from glossweave.operators import clustering as C
from glossweave.operators import graph as G
from glossweave.operators import ingest as I
from glossweave.operators import layout as L
from glossweave.operators import reconcile as B
from glossweave.operators import render as V
from glossweave.sources import dumps, store

SWITCHES = ("batch", "big-memory", "mem-profile", "common-cats", "no-weights", "small-only", "medium-only", "big-only", "huge-only", "alt-potential", "fast-pos", "timing")


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="glossweave", description=__doc__.splitlines()[0])
    for short, name in (("-H", "host"), ("-P", "port"), ("-p", "password"), ("-i", "input"), ("-o", "output")):
        p.add_argument(short, dest=name)
    p.add_argument("-f", "--file", dest="file", help="partitions for reconcile")
    p.add_argument("-n", "--dry-run", dest="dry", action="store_true", help="reconcile: write nothing")
    p.add_argument("-v", "--verbose", dest="verbose", action="store_true", help="reconcile: log the clusters too")
    p.add_argument("-d", dest="database", required=True)
    p.add_argument("-u", dest="user", required=True)
    many = lambda s: [x for x in s.split(",") if x]
    p.add_argument("-c", dest="components", type=many, default=[])
    p.add_argument("-s", dest="switches", type=many, default=[])
    p.add_argument("-r", dest="run", type=many, required=True)
    return p.parse_args(argv)


class Session:
    """The stored tables and the options of one run; with ``batch`` the components' model is held for all engines."""

    def __init__(self, spark: SparkSession, options: argparse.Namespace):
        self.spark, self.o, self.log = spark, options, []
        self.switches = set(options.switches)
        self._model: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def url(self) -> str | None:
        """Where tables are read from, if it is a database."""
        if self.o.database.startswith("jdbc:"):
            return self.o.database
        return f"jdbc:postgresql://{self.o.host}{f':{self.o.port}' if self.o.port else ''}/{self.o.database}" if self.o.host else None

    def read(self, name: str) -> DataFrame:
        if url := self.url():
            return store.read_jdbc(self.spark, url, name, self.o.user, self.o.password)
        return self.spark.read.parquet(f"{self.o.database}/{name}")

    def write(self, df: DataFrame, name: str, by: list[str]) -> None:
        store.replace_partitions(df, f"{self.o.database}/{name}", by)

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """Tables that may be made from their own last versions: all next ones are written before any takes its place."""
        for name, df in tables.items():
            store.write_table(df, f"{self.o.database}/{name}.next")
        for name in tables:
            store.write_table(self.spark.read.parquet(f"{self.o.database}/{name}.next"), f"{self.o.database}/{name}")

    def chosen(self) -> DataFrame:
        comps = self.read("components").withColumnRenamed("key", "root")
        if self.o.components:
            return G.select(comps, self.o.components)
        for name, (lo, hi) in G.SIZE_CLASSES.items():
            if f"{name}-only" in self.switches:
                return G.incoherent(comps, lo, hi)
        return G.incoherent(comps)

    def model(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pages, weighted edges, membership) of the chosen components."""
        if self._model is None or "batch" not in self.switches:
            pages = self.read("pages").join(self.chosen().select(F.col("root").alias("comp_id")), "comp_id", "left_semi")
            links = self.read("langlinks").join(pages.select(F.col("key").alias("src_id")), "src_id", "left_semi")
            base = G.edges(pages, links)
            cats = G.common_categories(base, self.read("categorylinks"), self.read("langlinks")) if "common-cats" in self.switches else None
            edges = G.weighted(base, cats, unit="no-weights" in self.switches)
            self._model = pages, edges, pages.select("key", F.col("comp_id").alias("root"))
            if "batch" in self.switches:
                self._model = tuple(t.persist() for t in self._model)
        return self._model

    def store_clusters(self, auth: str, found: DataFrame) -> None:
        pages, _, _ = self.model()
        m = G.meanings(pages, found).select(F.lit(auth).alias("auth"), "page_id", "meaning", F.col("root").alias("comp_id"))
        self.write(m, "meanings", ["auth", "comp_id"])

    def meanings(self, auth: str = V.AUTH) -> DataFrame:
        return self.read("meanings").where(F.col("auth") == auth).select("page_id", "meaning", F.col("comp_id").alias("root")).join(self.chosen().select("root"), "root", "left_semi")

    # ---- commands ----

    def do_import(self) -> None:
        """All languages' dumps; page links too where there are any. Records are tokenized once. What is rejected is stored by reason."""
        there = dumps.files(self.spark, self.o.input)
        kinds = ("page", "redirect", "langlinks", "categorylinks")
        dumps.require(there, kinds)
        more = bool(there.where("table = 'pagelinks'").take(1))
        lines = dumps.read_lines(self.spark, self.o.input)
        records = {k: stored(dumps.read_table(lines, k), k) for k in kinds + ("pagelinks",) * more}
        g = I.import_graph(records, with_pagelinks=more, keep=lambda pages: stored(pages, "pages"))
        steps = [k for k in g if k.startswith("rejected_")]
        for name in ("pages", "langlinks", "categorylinks") + ("pagelinks",) * more:
            store.write_table(g[name], f"{self.o.database}/{name}")
        store.write_table(I.rejects(*(g[k] for k in steps)), f"{self.o.database}/rejected")

    def find_comps(self) -> None:
        pages, links = self.read("pages"), self.read("langlinks")
        member = G.membership(pages, links)
        comps, p, l = G.saved(pages, links, member, G.components(pages, member))
        self.write_all({"components": comps, "pages": p, "langlinks": l})

    def positions(self) -> None:
        pages, edges, member = self.model()
        found = L.page_positions(pages, edges, member, alternative="alt-potential" in self.switches, fast="fast-pos" in self.switches)
        self.write(found.select("page_id", "x", "y", "z", F.col("root").alias("comp_id")), "positions", ["comp_id"])
        if "timing" in self.switches:
            self.tell("timing", C.per_component(pages, edges, member, _timing, "root string, ms double"))

    def engine(self, auth: str) -> None:
        self.store_clusters(auth, C.clusters(*self.model(), auth))

    def spatial(self) -> None:
        pages, edges, member = self.model()
        at = self.read("positions").select("page_id", "x", "y", "z")
        found = C.spatial(C.models(pages, edges, member, C.LIMIT), at, member)
        self.store_clusters("analysis.spatial", C.named(found))

    def random(self) -> None:
        """Stores no clusters; logs the least, mean and largest cost of each component."""
        costs = C.random_costs(C.models(*self.model(), C.LIMIT), 10).groupBy("root").agg(F.min("cost").alias("least"), F.avg("cost").alias("mean"), F.max("cost").alias("most"))
        self.tell("random", costs)

    def stats(self) -> None:
        pages, edges, member = self.model()
        self.tell("stats", G.stats(pages, member, edges))

    def _at(self) -> DataFrame:
        return self.read("positions").select("page_id", F.col("comp_id").alias("root"), "x", "y", "z").join(self.chosen().select("root"), "root", "left_semi")

    def visualize(self) -> None:
        pages, edges, _ = self.model()
        V.write_sharded(V.component_svg(pages, edges, self._at(), self.meanings()), f"{self.o.output}/svg", "root", "svg", ".svg")

    def skeleton(self) -> None:
        pages, edges, _ = self.model()
        nodes, links = L.meaning_graph(pages, self.meanings(), edges)
        V.write_sharded(V.skeleton_svg(nodes, links, L.skeleton_positions(nodes, links)), f"{self.o.output}/skeleton", "root", "svg", ".skel.svg")

    def serialize(self) -> None:
        pages, edges, _ = self.model()
        links = self.read("langlinks").join(pages.select(F.col("key").alias("src_id")), "src_id", "left_semi")
        ids = self.chosen().select("root", F.col("root").alias("comp_id"), "namespace")
        V.write_sharded(V.partition_xml(pages, links, edges, self.meanings(), ids, "common-cats" in self.switches), f"{self.o.output}/xml", "root", "xml", ".xml")

    def reconcile(self) -> None:
        """Changes that live links need to agree with the partitions under ``-f``: stored as ``changes`` and ``summaries`` under ``-o``, unless ``-n``.

        Live pages (lang, title, is_redirect) and links (lang, title, to_lang, to_title) are the stored tables live_pages
        and live_links; editions without a live page are not active."""
        parsed = V.read_partition_files(self.spark, self.o.file)
        members = V.cluster_pages(parsed).select(F.concat_ws(" ", "comp_id", "cluster_no").alias("cluster"), "lang", "title")
        live = self.read("live_pages")
        kept = B.guarded(members, live, live.select("lang").distinct())
        found = B.changes(kept, self.read("live_links"))
        self.log.append(("changes", found.count()))
        if self.o.verbose:
            self.log.append(("clusters", (members.select("cluster").distinct().count(), kept.select("cluster").distinct().count())))
        if not self.o.dry:
            store.write_table(found, f"{self.o.output}/changes")
            store.write_table(B.summaries(found), f"{self.o.output}/summaries")

    def tell(self, name: str, rows: DataFrame) -> None:
        """Rows of a component each go to a table of the log folder; the log has their number."""
        store.write_table(rows, f"{self.o.database}/log/{name}")
        self.log.append((name, self.spark.read.parquet(f"{self.o.database}/log/{name}").count()))

    def run(self) -> list:
        for name in self.o.run:
            if command := COMMANDS.get(name):
                began = time.perf_counter()
                command(self)
                self.log.append((name, round((time.perf_counter() - began) * 1000)))
        return self.log


def _timing(comp: C.Component):
    import pandas as pd

    return pd.DataFrame({"root": [comp.key], "ms": [L.timings(comp) if comp.pages else 0.0]})


def _engine(auth: str) -> Callable[[Session], None]:
    return lambda s: s.engine(auth)


COMMANDS: dict[str, Callable[[Session], None]] = {
    "import": Session.do_import,
    "find-comps": Session.find_comps,
    "positions": Session.positions,
    "cliques": _engine("analysis.cliques"),
    "spatial": Session.spatial,
    "betweenness": _engine("analysis.betweenness"),
    "newman-girvan": _engine("analysis.newman-girvan"),
    "genetic": _engine("analysis.genetic"),
    "random": Session.random,
    "stats": Session.stats,
    "visualize": Session.visualize,
    "skel-vis": Session.skeleton,
    "serialize": Session.serialize,
    "reconcile": Session.reconcile,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list:
    options = parse(argv)
    return Session(spark or SparkSession.builder.appName("glossweave").getOrCreate(), options).run()


if __name__ == "__main__":
    for entry in main():
        print(*entry)
