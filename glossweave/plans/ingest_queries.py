"""Queries on dump records and their import, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.session import table
from glossweave.operators import ingest as I
from glossweave.sources import dumps, raw, store
from glossweave.sources.raw import raw as records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql(select: str, *parts: str) -> str:
    return f"WITH {raw.ctes('raw_categorylinks')}{''.join(parts)}\n{select}"


# Pages, their titles, and what redirects resolve to, in SQL: of either set of records.
def _pages(name: str) -> str:
    return f""",
pages AS (SELECT lang || ':' || page_id AS key, lang, CAST(namespace AS INTEGER) AS namespace, title FROM {name}_page WHERE namespace IN ('0', '14')),
titles AS (SELECT lang, namespace, title, min(key) AS key FROM pages GROUP BY ALL),
asked AS (SELECT lang || ':' || from_id AS key, lang, CAST(namespace AS INTEGER) AS namespace, title FROM {name}_redirect WHERE namespace IN ('0', '14')),
judged AS (SELECT a.key, t.key AS redirect_id, CASE WHEN p.key IS NULL THEN 'nonexistent source' WHEN p.namespace <> a.namespace THEN 'cross-namespace' WHEN t.key IS NULL THEN 'nonexistent target' END AS reason
    FROM asked a LEFT JOIN pages p ON p.key = a.key LEFT JOIN titles t ON t.lang = a.lang AND t.namespace = a.namespace AND t.title = a.title),
moved AS (SELECT key, max(redirect_id) AS redirect_id FROM judged WHERE reason IS NULL GROUP BY key)"""


CHAIN, WIKI = _pages("chain"), _pages("raw")
_MIDDLE = "SELECT key, redirect_id FROM moved WHERE key NOT IN (SELECT redirect_id FROM moved)"
_SOURCE = "SELECT key, redirect_id FROM moved WHERE redirect_id NOT IN (SELECT key FROM moved)"
LINKS = f""",
kept AS ({_MIDDLE}),
l AS (SELECT r.*, r.lang || ':' || from_id AS key, p.namespace, k.redirect_id,
    CASE WHEN p.namespace = 0 THEN r.title WHEN contains(r.title, ':') THEN substr(r.title, instr(r.title, ':') + 1) ELSE '' END AS bare
    FROM raw_langlinks r LEFT JOIN pages p ON p.key = r.lang || ':' || from_id LEFT JOIN kept k ON k.key = p.key),
links AS (SELECT l.key AS src_id, t.key AS dst_id, CASE WHEN l.lang = to_lang THEN 'same language' WHEN l.namespace IS NULL THEN 'silent' WHEN l.redirect_id IS NOT NULL THEN 'redirect source' WHEN t.key IS NULL THEN 'nonexistent target' END AS reason
    FROM l LEFT JOIN titles t ON t.lang = to_lang AND t.namespace = l.namespace AND t.title = bare)"""


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.pages(records(spark, sf_dir, "raw_page"))
    return I.remove_double_redirects(I.with_redirects(p, I.redirects(p, records(spark, sf_dir, "raw_redirect"))[0]))


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    p = I.pages(records(spark, sf_dir, "chain_page"))
    return p, I.redirects(p, records(spark, sf_dir, "chain_redirect"))


@query(sql("SELECT key, lang, namespace, title FROM pages", WIKI))
def pages_filtered(spark, sf_dir):
    return I.pages(records(spark, sf_dir, "raw_page")).drop("redirect_id")


@query(sql("SELECT key, redirect_id FROM judged WHERE reason IS NULL", CHAIN))
def redirects_resolved(spark, sf_dir):
    return _chain(spark, sf_dir)[1][0]


@query(sql("SELECT key, reason FROM judged WHERE reason IS NOT NULL", CHAIN))
def redirects_rejected(spark, sf_dir):
    return _chain(spark, sf_dir)[1][1].select("key", "reason")


@query(sql(_MIDDLE, CHAIN))
def double_redirect_middle(spark, sf_dir):
    p, (ok, _) = _chain(spark, sf_dir)
    return I.remove_double_redirects(I.with_redirects(p, ok), "middle").where("redirect_id is not null").select("key", "redirect_id")


@query(sql(_SOURCE, CHAIN))
def double_redirect_source(spark, sf_dir):
    p, (ok, _) = _chain(spark, sf_dir)
    return I.remove_double_redirects(I.with_redirects(p, ok), "source").where("redirect_id is not null").select("key", "redirect_id")


@query(sql("SELECT src_id, dst_id FROM links WHERE reason IS NULL", WIKI, LINKS))
def langlinks_resolved(spark, sf_dir):
    return I.langlinks(_wiki(spark, sf_dir), records(spark, sf_dir, "raw_langlinks"))[0]


@query(sql("SELECT reason, count(*) AS n FROM links WHERE reason <> 'silent' GROUP BY reason", WIKI, LINKS))
def langlinks_rejected(spark, sf_dir):
    return I.langlinks(_wiki(spark, sf_dir), records(spark, sf_dir, "raw_langlinks"))[1].groupBy("reason").agg(F.count("*").alias("n"))


_PAGELINKS = """, pl AS (SELECT r.lang || ':' || from_id AS src, p.key AS there, t.key AS dst FROM raw_pagelinks r LEFT JOIN pages p ON p.key = r.lang || ':' || from_id
    LEFT JOIN titles t ON t.lang = r.lang AND t.namespace = CAST(r.namespace AS INTEGER) AND t.title = r.title)"""
_CATLINKS = """, cl AS (SELECT r.lang || ':' || from_id AS src, p.key AS there, t.key AS dst FROM raw_categorylinks r LEFT JOIN pages p ON p.key = r.lang || ':' || from_id
    LEFT JOIN titles t ON t.lang = r.lang AND t.namespace = 14 AND t.title = r.title)"""


@query(sql("SELECT src AS src_id, dst AS dst_id FROM pl WHERE there IS NOT NULL AND dst IS NOT NULL", WIKI, _PAGELINKS))
def pagelinks_resolved(spark, sf_dir):
    return I.pagelinks(I.pages(records(spark, sf_dir, "raw_page")), records(spark, sf_dir, "raw_pagelinks"))[0]


@query(sql("SELECT src AS page_id, dst AS category_id FROM cl WHERE there IS NOT NULL AND dst IS NOT NULL", WIKI, _CATLINKS))
def categorylinks_resolved(spark, sf_dir):
    return I.categorylinks(I.pages(records(spark, sf_dir, "raw_page")), records(spark, sf_dir, "raw_categorylinks"))[0]


@query(sql("""SELECT 0 AS step, CASE WHEN there IS NULL THEN 'nonexistent source' ELSE 'nonexistent target' END AS reason, count(*) AS n FROM pl WHERE there IS NULL OR dst IS NULL GROUP BY ALL
    UNION ALL SELECT 1, CASE WHEN there IS NULL THEN 'nonexistent source' ELSE 'nonexistent target' END, count(*) FROM cl WHERE there IS NULL OR dst IS NULL GROUP BY ALL""", WIKI, _PAGELINKS, _CATLINKS))  # fmt: skip
def links_rejected(spark, sf_dir):
    p = I.pages(records(spark, sf_dir, "raw_page"))
    return I.rejects(I.pagelinks(p, records(spark, sf_dir, "raw_pagelinks"))[1], I.categorylinks(p, records(spark, sf_dir, "raw_categorylinks"))[1])


@query(sql("SELECT r.lang, CAST(r.namespace AS INTEGER) AS namespace, r.title, t.key FROM (SELECT DISTINCT lang, namespace, title FROM raw_pagelinks) r LEFT JOIN titles t ON t.lang = r.lang AND t.namespace = CAST(r.namespace AS INTEGER) AND t.title = r.title", WIKI))
def page_key_lookup(spark, sf_dir):
    wanted = records(spark, sf_dir, "raw_pagelinks").select("lang", F.col("namespace").cast("int").alias("namespace"), "title").distinct()
    return I.page_key(I.pages(records(spark, sf_dir, "raw_page")), wanted)


@query(sql("SELECT w.key, p.lang, p.title FROM (SELECT DISTINCT lang || ':' || from_id AS key FROM raw_langlinks) w LEFT JOIN pages p ON p.key = w.key", WIKI))
def page_lookup(spark, sf_dir):
    wanted = records(spark, sf_dir, "raw_langlinks").select(F.concat("lang", F.lit(":"), "from_id").alias("key")).distinct()
    return I.page_by_key(I.pages(records(spark, sf_dir, "raw_page")), wanted).select("key", "lang", "title")


@query(sql(f"""SELECT 'pages' AS name, count(*) AS n FROM pages UNION ALL SELECT 'redirects', count(*) FROM ({_MIDDLE}) UNION ALL SELECT 'langlinks', count(*) FROM links WHERE reason IS NULL
    UNION ALL SELECT 'categorylinks', count(*) FROM cl WHERE there IS NOT NULL AND dst IS NOT NULL""", WIKI, LINKS, _CATLINKS))  # fmt: skip
def import_graph(spark, sf_dir):
    kinds = ("page", "redirect", "langlinks", "categorylinks")
    g = I.import_graph({k: records(spark, sf_dir, f"raw_{k}") for k in kinds})
    count = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("pages", g["pages"]).union(count("redirects", g["pages"].where("redirect_id is not null"))).union(count("langlinks", g["langlinks"])).union(count("categorylinks", g["categorylinks"]))


# ---- dumps ----


#: Keys of which a nation's come into one line, so that lines keep their length as customers get more, as those of dumps do.
_A_LINE = 25_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as INSERT lines of a page dump, a line for a nation's among ``_A_LINE`` keys, with names that need every kind of escape."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.col("c_name"), F.lit("_(a,b)'\"\\"), F.col("c_mktsegment"))
    row = dumps.insert_line("page", F.col("c_custkey").cast("string"), F.lit("0"), dumps.quoted(name), F.lit("NULL"))
    line = F.concat(F.lit("INSERT INTO `page` VALUES "), F.array_join(F.array_sort(F.collect_list(row)), ","), F.lit(";"))
    return c.groupBy("c_nationkey", F.floor(F.col("c_custkey") / _A_LINE)).agg(line.alias("value")).select(F.lit("xx").alias("lang"), F.lit("20240101").alias("date"), F.lit("page").alias("table"), "value")


@query("SELECT CAST(c_custkey AS VARCHAR) AS page_id, '0' AS namespace, replace(c_name || '_(a,b)''\"\\' || c_mktsegment, '_', ' ') AS title FROM customer")
def dump_roundtrip(spark, sf_dir):
    return dumps.read_table(_lines(spark, sf_dir), "page").select("page_id", "namespace", "title")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of several tables in one file, a file a region: structure comments, INSERT lines and others, numbered."""
    n = table(spark, sf_dir, "nation")
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(("page", "redirect", "page_props", "langlinks"))))
    rows = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file"), "n_nationkey", F.explode(kinds).alias("x")).select("file", "n_nationkey", "x.*")
    head = rows.select("file", "k", "t").distinct().select("file", (F.col("k") * 1000000).alias("line_no"), F.concat(F.lit("-- Table structure for table `"), F.col("t"), F.lit("`")).alias("value"))
    body = rows.select("file", (F.col("k") * 1000000 + 10 + F.col("n_nationkey")).alias("line_no"), F.concat(F.lit("INSERT INTO `"), F.col("t"), F.lit("` VALUES (1);")).alias("value"))
    other = head.select("file", (F.col("line_no") + 1).alias("line_no"), F.lit("CREATE TABLE x (").alias("value"))
    first = rows.select("file").distinct().select("file", F.lit(-1).alias("line_no"), F.lit("INSERT INTO `lost` VALUES (1);").alias("value"))
    return head.union(body).union(other).union(first)


@query("SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS file, t AS \"table\", count(*) * m AS n FROM nation CROSS JOIN (SELECT 'page' AS t, 1 AS m UNION ALL SELECT 'redirect', 2 UNION ALL SELECT 'langlinks', 1) GROUP BY n_regionkey, t, m")
def dump_split_by_table(spark, sf_dir):
    return dumps.split_by_table(_whole(spark, sf_dir)).groupBy("file", "table").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT replace(lower(replace(n_name, ' ', '_')), '_', '-') AS lang FROM nation")
def dump_languages(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("wiki-20240101-page.sql.gz"))
    lines = n.select(F.translate(F.regexp_extract(name, dumps._NAME, 1), "_", "-").alias("lang"), F.regexp_extract(name, dumps._NAME, 3).alias("table"))
    return dumps.languages(lines)


@query("""SELECT CASE WHEN c_nationkey < 10 THEN 'new' ELSE 'old' END AS auth, count(*) AS n FROM customer GROUP BY 1
    UNION ALL SELECT 'added', count(*) FROM customer WHERE c_nationkey = 3""")
def replace_partition(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.select(F.lit("old").alias("auth"), F.col("c_nationkey").alias("part"), "c_custkey")
    new = c.where("c_nationkey < 10").select(F.lit("new").alias("auth"), F.col("c_nationkey").alias("part"), "c_custkey")
    more = c.where("c_nationkey = 3").select(F.lit("added").alias("auth"), (F.col("c_nationkey") + 1000).alias("part"), "c_custkey")
    return store.replaced(old, new.unionByName(more), ["part"]).groupBy("auth").agg(F.count("*").alias("n"))
