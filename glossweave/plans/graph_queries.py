"""Queries on components, edges and weights of the projected graph, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.keys import DNS, OID, URL, uuid5_sql
from glossweave.functions.session import stored
from glossweave.operators import graph as G
from glossweave.sources import projection


#: Where a session keeps what it made of a graph: the tables' files are the key, so a graph that has changed is made anew.
_STORED: dict[tuple, DataFrame] = {}


class World:
    """The projected graph's tables, each made and stored at its first use, once a session for all queries on the same files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def _files(self) -> tuple:
        return (self.spark.sparkContext.applicationId, *projection.files(self.spark, self.sf_dir))

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (*self._files, name)
        if key not in _STORED:
            _STORED[key] = stored(make(), name)
        return self.spark.read.schema(_STORED[key].schema).parquet(*_STORED[key].inputFiles())

    def _table(self, name: str) -> DataFrame:
        return self._once(name, lambda: projection.graph(self.spark, self.sf_dir, name))

    @cached_property
    def pages(self) -> DataFrame:
        return self._table("pages")

    @cached_property
    def links(self) -> DataFrame:
        return self._table("langlinks")

    @cached_property
    def cats(self) -> DataFrame:
        return self._table("categorylinks")

    @cached_property
    def pagelinks(self) -> DataFrame:
        return self._table("pagelinks")

    @cached_property
    def member(self) -> DataFrame:
        return self._once("member", lambda: G.membership(self.pages, self.links))

    @cached_property
    def comps(self) -> DataFrame:
        return self._once("comps", lambda: G.components(self.pages, self.member))

    @cached_property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: G.edges(self.pages, self.links))

    @cached_property
    def mixed(self) -> DataFrame:
        """(key, root) of incoherent components: what clusters are sought in."""
        return self._once("mixed", lambda: self.member.join(G.incoherent(self.comps).select("root"), "root", "left_semi"))

    @cached_property
    def mixed_edges(self) -> DataFrame:
        return self.edges.join(self.mixed.select(F.col("key").alias("a")), "a", "left_semi")

    @cached_property
    def parity(self) -> DataFrame:
        """(key, root, cluster): a fixed clustering by arithmetic, of pages in articles that redirect nowhere."""
        p = self.pages.where("redirect_id is null and namespace = 0").join(self.mixed, "key")
        return p.select("key", "root", (F.split_part("key", F.lit(":"), F.lit(2)).cast("long") % 3).cast("string").alias("cluster"))

    @cached_property
    def positions(self) -> DataFrame:
        """(page_id, root, x, y, z): positions by arithmetic, of the same pages."""
        n = F.split_part("key", F.lit(":"), F.lit(2)).cast("long")
        return self.parity.select(F.col("key").alias("page_id"), "root", (n % 17).cast("double").alias("x"), (n % 23).cast("double").alias("y"), (n % 5).cast("double").alias("z"))


COMPS = """,
hops AS (SELECT src_id AS a, dst_id AS b FROM langlinks UNION SELECT dst_id, src_id FROM langlinks
    UNION SELECT key, redirect_id FROM pages WHERE redirect_id IS NOT NULL UNION SELECT redirect_id, key FROM pages WHERE redirect_id IS NOT NULL),
reach AS (SELECT a AS v, a AS r FROM hops UNION SELECT h.b, reach.r FROM reach JOIN hops h ON h.a = reach.v),
member AS (SELECT key, coalesce(r, key) AS root FROM pages LEFT JOIN (SELECT v, min(r) AS r FROM reach GROUP BY v) ON v = key),
per_lang AS (SELECT root, lang, count(*) FILTER (WHERE redirect_id IS NULL) AS n, count(*) AS n_all FROM pages JOIN member USING (key) GROUP BY root, lang),
firsts AS (SELECT root, arg_min(namespace, key) AS namespace FROM pages JOIN member USING (key) GROUP BY root),
all_comps AS (SELECT root, max(n) <= 1 AS coherent, CAST(sum(n) AS INTEGER) AS size, CAST(count(*) FILTER (WHERE n > 0) AS INTEGER) AS n_langs FROM per_lang GROUP BY root),
comps AS (SELECT root, namespace, coherent, size, n_langs FROM all_comps JOIN firsts USING (root) WHERE size <> 1),
mixed AS (SELECT key, root FROM member JOIN comps USING (root) WHERE NOT coherent)"""
EDGES = """,
occ AS (SELECT src_id, coalesce(redirect_id, dst_id) AS d, redirect_id IS NOT NULL AS redirected FROM langlinks LEFT JOIN pages ON key = dst_id),
edges AS (SELECT least(src_id, d) AS a, greatest(src_id, d) AS b, count(*) FILTER (WHERE NOT redirected) AS n_direct, count(*) FILTER (WHERE redirected) AS n_redirect,
    count(*) FILTER (WHERE NOT redirected) + 0.1 * count(*) FILTER (WHERE redirected) AS weight FROM occ GROUP BY 1, 2)"""
COMMON = """,
shared AS (SELECT e.a, e.b, count(DISTINCT l.dst_id) AS n FROM edges e JOIN categorylinks ca ON ca.page_id = e.a JOIN langlinks l ON l.src_id = ca.category_id
    JOIN categorylinks cb ON cb.page_id = e.b AND cb.category_id = l.dst_id GROUP BY e.a, e.b)"""
PARITY = """,
parity AS (SELECT key, root, CAST(CAST(split_part(key, ':', 2) AS BIGINT) % 3 AS VARCHAR) AS cluster FROM pages JOIN mixed USING (key) WHERE redirect_id IS NULL AND namespace = 0),
positions AS (SELECT key AS page_id, root, CAST(CAST(split_part(key, ':', 2) AS BIGINT) % 17 AS DOUBLE) AS x, CAST(CAST(split_part(key, ':', 2) AS BIGINT) % 23 AS DOUBLE) AS y, CAST(CAST(split_part(key, ':', 2) AS BIGINT) % 5 AS DOUBLE) AS z FROM parity),
grown AS (SELECT key, root, cluster FROM parity UNION ALL SELECT p.key, q.root, q.cluster FROM pages p JOIN parity q ON p.redirect_id = q.key)"""
MEANINGS = f""",
meaning_of AS (SELECT root, cluster, {uuid5_sql(URL, "string_agg(key, ' ' ORDER BY key)")} AS meaning FROM grown GROUP BY root, cluster),
meanings AS (SELECT key AS page_id, meaning, root FROM grown JOIN meaning_of USING (root, cluster))"""


def sql(select: str, *parts: str) -> str:
    return f"WITH RECURSIVE {projection.ctes('pagelinks')}{''.join(parts)}\n{select}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Registers a function of a World under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(World(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(sql("SELECT root AS comp_root, namespace, size, n_langs FROM comps WHERE NOT coherent", COMPS))
def incoherent_components(w: World) -> DataFrame:
    return G.incoherent(w.comps).select(F.col("root").alias("comp_root"), "namespace", "size", "n_langs")


@query(sql("SELECT root AS comp_root, namespace, coherent, size FROM comps", COMPS))
def components_all(w: World) -> DataFrame:
    return w.comps.select(F.col("root").alias("comp_root"), "namespace", "coherent", "size")


@query(sql("SELECT key AS page_key, root AS comp_root FROM member", COMPS))
def component_membership(w: World) -> DataFrame:
    return w.member.select(F.col("key").alias("page_key"), F.col("root").alias("comp_root"))


def _uuids(namespace: str, sep: str) -> str:
    return sql(f"SELECT root AS comp_root, {uuid5_sql(namespace, f'''string_agg(key, '{sep}' ORDER BY key)''')} AS comp_id FROM member JOIN comps USING (root) GROUP BY root", COMPS)


@query(_uuids(OID, "#"))
def component_uuid(w: World) -> DataFrame:
    return G.component_keys(w.member.join(w.comps, "root", "left_semi")).withColumnRenamed("root", "comp_root")


@query(_uuids(DNS, ""))
def component_uuid_dns(w: World) -> DataFrame:
    return G.component_keys(w.member.join(w.comps, "root", "left_semi"), "dns").withColumnRenamed("root", "comp_root")


_CLASSES = {"small": (3, 5), "medium": (6, 10), "big": (11, 20), "huge": (21, None)}


@query(sql("SELECT CASE WHEN size <= 5 THEN 'small' WHEN size <= 10 THEN 'medium' WHEN size <= 20 THEN 'big' ELSE 'huge' END AS class, count(*) AS n, CAST(sum(size) AS BIGINT) AS pages FROM comps WHERE NOT coherent AND size >= 3 GROUP BY 1", COMPS))
def component_size_classes(w: World) -> DataFrame:
    return G.size_classes(w.comps, _CLASSES)


@query(sql("SELECT root AS comp_root, size FROM comps WHERE NOT coherent AND size BETWEEN 4 AND 12", COMPS))
def incoherent_between(w: World) -> DataFrame:
    return G.incoherent(w.comps, 4, 12).select(F.col("root").alias("comp_root"), "size")


@query(sql("SELECT root AS comp_root, size FROM comps WHERE root IN ('c:1', 'c:10', 'c:100', 'k:AUTOMOBILE:0')", COMPS))
def component_selection(w: World) -> DataFrame:
    return G.select(w.comps, ["c:1", "c:10", "c:100", "k:AUTOMOBILE:0"]).select(F.col("root").alias("comp_root"), "size")


@query(sql("""SELECT 'drop' AS variant, count(*) AS n_components FROM comps UNION ALL SELECT 'keep', count(*) FROM all_comps
    UNION ALL SELECT 'linked', count(*) FROM all_comps WHERE root IN (SELECT root FROM member JOIN langlinks ON src_id = key)""", COMPS))  # fmt: skip
def component_keep_singletons(w: World) -> DataFrame:
    kept = G.components(w.pages, w.member, drop_singletons=False)
    linked = G.components(w.pages, w.member, drop_singletons=False, langlinks=w.links)
    count = lambda name, df: df.agg(F.lit(name).alias("variant"), F.count("*").alias("n_components"))
    return count("drop", w.comps).union(count("keep", kept)).union(count("linked", linked))


@query(sql(f"""SELECT key AS page_key, comp_id FROM pages LEFT JOIN (SELECT root, {uuid5_sql(OID, "string_agg(key, '#' ORDER BY key)")} AS comp_id FROM member JOIN comps USING (root) GROUP BY root) i
    ON i.root = (SELECT root FROM member m WHERE m.key = pages.key)""", COMPS))  # fmt: skip
def saved_pages(w: World) -> DataFrame:
    return G.saved(w.pages, w.links, w.member, w.comps)[1].select(F.col("key").alias("page_key"), "comp_id")


@query(sql(f"""SELECT comp_id, count(*) AS n FROM langlinks LEFT JOIN member ON key = src_id LEFT JOIN
    (SELECT root, {uuid5_sql(OID, "string_agg(key, '#' ORDER BY key)")} AS comp_id FROM member JOIN comps USING (root) GROUP BY root) USING (root) GROUP BY comp_id""", COMPS))  # fmt: skip
def saved_langlinks(w: World) -> DataFrame:
    return G.saved(w.pages, w.links, w.member, w.comps)[2].groupBy("comp_id").agg(F.count("*").alias("n"))


@query(sql("SELECT key AS page_key, redirect_id FROM pages WHERE redirect_id IS NOT NULL"))
def stored_redirects(w: World) -> DataFrame:
    return w.pages.where("redirect_id is not null").select(F.col("key").alias("page_key"), "redirect_id")


@query(sql("SELECT a, b, n_direct, n_redirect FROM edges", EDGES))
def canonical_edges(w: World) -> DataFrame:
    return w.edges.select("a", "b", "n_direct", "n_redirect")


@query(sql("SELECT a, b, round(CAST(weight AS DOUBLE), 6) AS weight FROM edges", EDGES))
def edge_weights(w: World) -> DataFrame:
    return G.weighted(w.edges).select("a", "b", F.round("weight", 6).alias("weight"))


@query(sql("SELECT a, b, CAST(1 AS DOUBLE) AS weight FROM edges", EDGES))
def edge_weights_unit(w: World) -> DataFrame:
    return G.weighted(w.edges, unit=True).select("a", "b", "weight")


@query(sql("SELECT a, b, n FROM shared", EDGES, COMMON))
def common_categories(w: World) -> DataFrame:
    return G.common_categories(w.edges, w.cats, w.links)


@query(sql("SELECT a, b, round(CAST(weight AS DOUBLE) + 0.8 * sqrt(coalesce(n, 0)), 6) AS weight FROM edges LEFT JOIN shared USING (a, b)", EDGES, COMMON))
def edge_weights_common_cats(w: World) -> DataFrame:
    return G.weighted(w.edges, G.common_categories(w.edges, w.cats, w.links)).select("a", "b", F.round("weight", 6).alias("weight"))


@query(sql("SELECT e.a, e.b, count(DISTINCT l.dst_id) AS n FROM edges e JOIN pagelinks pa ON pa.src_id = e.a JOIN langlinks l ON l.src_id = pa.dst_id JOIN pagelinks pb ON pb.src_id = e.b AND pb.dst_id = l.dst_id GROUP BY e.a, e.b", EDGES))
def common_links(w: World) -> DataFrame:
    return G.common_links(w.edges, w.pagelinks, w.links)


@query(sql("SELECT a, b, round(CAST(weight AS DOUBLE) + 0.2 * ln(1 + coalesce(n, 0)), 6) AS weight FROM edges LEFT JOIN shared USING (a, b)", EDGES, COMMON))
def edge_weights_common_links(w: World) -> DataFrame:
    return G.weighted(w.edges, links=G.common_links(w.edges, w.pagelinks, w.links)).select("a", "b", F.round("weight", 6).alias("weight"))


@query(sql("""SELECT root AS comp_root, coalesce(p.n, 0) AS n_pages, coalesce(e.n, 0) AS n_links FROM (SELECT root, count(*) AS n FROM pages JOIN member USING (key) WHERE redirect_id IS NULL GROUP BY root) p
    FULL JOIN (SELECT root, count(*) AS n FROM edges JOIN member ON key = a GROUP BY root) e USING (root)""", COMPS, EDGES))  # fmt: skip
def component_stats(w: World) -> DataFrame:
    return G.stats(w.pages, w.member, w.edges).withColumnRenamed("root", "comp_root")


@query(sql("SELECT page_id AS page_key, meaning FROM meanings", COMPS, PARITY, MEANINGS))
def meaning_keys(w: World) -> DataFrame:
    return G.meanings(w.pages, w.parity).select(F.col("page_id").alias("page_key"), "meaning")


@query(sql("SELECT key, title FROM pages WHERE starts_with(upper(title), 'PART#1')"))
def title_prefix_search(w: World) -> DataFrame:
    from glossweave.operators.ingest import title_prefix

    return title_prefix(w.pages, "part#1").select("key", "title")


@query(sql("""SELECT comp, lang, n FROM (SELECT root AS comp, lang, count(*) AS n, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, lang) AS k
    FROM pages JOIN mixed USING (key) WHERE redirect_id IS NULL GROUP BY root, lang) WHERE k <= 3""", COMPS))  # fmt: skip
def top_languages(w: World) -> DataFrame:
    from glossweave.operators.ingest import top_languages as top

    return top(w.pages.where("redirect_id is null").join(w.mixed, "key").withColumnRenamed("root", "comp"))
