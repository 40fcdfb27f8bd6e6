"""Queries on clusterings, layouts, drawings, partitions and changes of the projected graph, with their SQL.

Greedy merging in a stated order (random, spatial, by betweenness) is stated row by row, as a recursive fold. Searches that
no SQL states are told by what must hold of them: all pages are in, no cluster has a language twice, the reported cost is
the weight between clusters, and no two linked clusters could be merged; clusters of single pages fail that. Of layouts,
energies and gradients at fixed positions are stated, and that descent ends no higher than it began.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.operators import clustering as C
from glossweave.operators import graph as G
from glossweave.operators import layout as L
from glossweave.operators import reconcile as B
from glossweave.operators import render as V
from glossweave.plans.graph_queries import COMMON, COMPS, EDGES, MEANINGS, ORACLES, PARITY, QUERIES, World, query, sql

_ = (ORACLES, QUERIES)
VALID = sql("SELECT root AS comp_root, CAST(size AS BIGINT) AS n_pages, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS DOUBLE) AS cost_gap, CAST(0 AS BIGINT) AS mergeable FROM comps WHERE NOT coherent", COMPS)

#: Greedy merging along ``ordered`` (root, k, a, b, w), k from 1: a component's nodes are a list that each edge changes.
_FOLD = """,
nodes_of AS (SELECT DISTINCT root, orig FROM ordered),
start AS (SELECT n.root, list({'k': p.key, 'l': p.lang, 'c': p.key} ORDER BY p.key) AS nodes FROM nodes_of n JOIN mixed m ON m.root = n.orig JOIN pages p ON p.key = m.key WHERE p.redirect_id IS NULL GROUP BY n.root),
fold AS (SELECT root, CAST(0 AS BIGINT) AS k, nodes, CAST(0 AS DOUBLE) AS cost FROM start
    UNION ALL SELECT root, k + 1, CASE WHEN i = j OR clash THEN nodes ELSE list_transform(nodes, lambda n: {'k': n.k, 'l': n.l, 'c': CASE WHEN n.c = j THEN i ELSE n.c END}) END, cost + CASE WHEN i <> j AND clash THEN w ELSE 0 END
    FROM (SELECT *, list_has_any(list_transform(list_filter(nodes, lambda n: n.c = i), lambda n: n.l), list_transform(list_filter(nodes, lambda n: n.c = j), lambda n: n.l)) AS clash
        FROM (SELECT f.*, o.w, list_filter(f.nodes, lambda n: n.k = o.a)[1].c AS i, list_filter(f.nodes, lambda n: n.k = o.b)[1].c AS j FROM fold f JOIN ordered o ON o.root = f.root AND o.k = f.k + 1))),
folded AS (SELECT root, nodes, cost FROM fold QUALIFY row_number() OVER (PARTITION BY root ORDER BY k DESC) = 1),
flat AS (SELECT root, unnest(nodes) AS n, cost FROM folded),
clustered AS (SELECT root, n.k AS page_key, min(n.k) OVER (PARTITION BY root, n.c) AS cluster, cost FROM flat)"""
_MIXED_EDGES = "edges JOIN mixed ON mixed.key = a"
_CLUSTERED = "SELECT root AS comp_root, page_key, cluster, round(cost, 6) AS cost FROM clustered"


def _ordered(select: str) -> str:
    return f""",
ordered AS ({select})"""


def _random(seeds: int) -> str:
    return _ordered(f"SELECT root || '#' || seed AS root, root AS orig, row_number() OVER (PARTITION BY root, seed ORDER BY md5(seed || '|' || a || '|' || b), a, b) AS k, a, b, CAST(weight AS DOUBLE) AS w FROM {_MIXED_EDGES} CROSS JOIN range({seeds}) AS s(seed)")


def _shortest(arcs_of: str) -> str:
    """Distances and numbers of shortest paths between all pages of components (key, root), and what passes each edge."""
    return f""",
arcs AS (SELECT e.a AS u, e.b AS v, e.a || ' ' || e.b AS e, size FROM edges e JOIN {arcs_of} m ON m.key = a JOIN comps USING (root) UNION ALL SELECT e.b, e.a, e.a || ' ' || e.b, size FROM edges e JOIN {arcs_of} m ON m.key = a JOIN comps USING (root)),
steps AS (SELECT DISTINCT u AS s, u AS t, 0 AS d FROM arcs UNION SELECT w.s, a.v, w.d + 1 FROM steps w JOIN arcs a ON a.u = w.t WHERE w.d < a.size - 1),
dist AS (SELECT s, t, min(d) AS d FROM steps GROUP BY s, t),
paths AS (SELECT s, t, d, CAST(1 AS DOUBLE) AS n FROM dist WHERE d = 0
    UNION ALL SELECT p.s, a.v, p.d + 1, sum(p.n) FROM paths p JOIN arcs a ON a.u = p.t JOIN dist x ON x.s = p.s AND x.t = a.v AND x.d = p.d + 1 GROUP BY p.s, a.v, p.d + 1),
shares AS (SELECT e, p.n * q.n / r.n AS share FROM arcs JOIN paths p ON p.t = u JOIN paths q ON q.s = v JOIN paths r ON r.s = p.s AND r.t = q.t WHERE p.d + 1 + q.d = r.d),
passed AS (SELECT split_part(e, ' ', 1) AS a, split_part(e, ' ', 2) AS b, sum(share) AS eb FROM shares GROUP BY e)"""


def _valid(w: World, found: DataFrame) -> DataFrame:
    return C.validity(found, w.pages, w.mixed_edges, w.mixed).withColumnRenamed("root", "comp_root").withColumn("cost_gap", F.abs("cost_gap"))


def _searched(w: World, auth: str) -> DataFrame:
    return C.clusters(w.pages, w.mixed_edges, w.mixed, auth)


def _rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("root").alias("comp_root"), F.col("key").alias("page_key"), "cluster", F.round("cost", 6).alias("cost"))


@query(sql(_CLUSTERED, COMPS, EDGES, _shortest("mixed"), _ordered(f"SELECT root, root AS orig, row_number() OVER (PARTITION BY root ORDER BY round(eb, 9), a, b) AS k, a, b, CAST(weight AS DOUBLE) AS w FROM {_MIXED_EDGES} JOIN passed USING (a, b)"), _FOLD))
def betweenness_clusters(w: World) -> DataFrame:
    return _rows(_searched(w, "analysis.betweenness"))


@query(VALID)
def newman_girvan_clusters(w: World) -> DataFrame:
    return _valid(w, _searched(w, "analysis.newman-girvan"))


@query(VALID)
def genetic_clusters(w: World) -> DataFrame:
    return _valid(w, _searched(w, "analysis.genetic"))


@query(VALID)
def clique_clusters(w: World) -> DataFrame:
    return _valid(w, _searched(w, "analysis.cliques"))


@query(sql("SELECT split_part(root, '#', 1) AS comp_root, page_key, cluster, round(cost, 6) AS cost FROM clustered", COMPS, EDGES, _random(1), _FOLD))
def greedy_random(w: World) -> DataFrame:
    return _rows(C.named(C.random_costs(C.models(w.pages, w.mixed_edges, w.mixed), 1)))


@query(sql("SELECT split_part(root, '#', 1) AS comp_root, count(*) AS n, round(min(cost), 6) AS least, round(avg(cost), 6) AS mean, round(max(cost), 6) AS most FROM folded GROUP BY 1", COMPS, EDGES, _random(10), _FOLD))
def random_cost_stats(w: World) -> DataFrame:
    costs = C.random_costs(C.models(w.pages, w.mixed_edges, w.mixed), 10).select("root", "cost")
    return costs.groupBy(F.col("root").alias("comp_root")).agg(F.count("*").alias("n"), *(F.round(f("cost"), 6).alias(c) for f, c in ((F.min, "least"), (F.avg, "mean"), (F.max, "most"))))


def _by_number(key: str, at: str) -> str:
    return f"(CAST(split_part({key}, ':', 2) AS BIGINT) % {at})"


@query(sql(_CLUSTERED, COMPS, EDGES, _ordered(f"SELECT root, root AS orig, row_number() OVER (PARTITION BY root ORDER BY {' + '.join(f'pow({_by_number("a", m)} - {_by_number("b", m)}, 2)' for m in ('17', '23', '5'))}, a, b) AS k, a, b, CAST(weight AS DOUBLE) AS w FROM {_MIXED_EDGES}"), _FOLD))
def spatial_clusters(w: World) -> DataFrame:
    n = F.split_part("key", F.lit(":"), F.lit(2)).cast("long")
    at = w.pages.where("redirect_id is null").join(w.mixed, "key").select(F.col("key").alias("page_id"), *((n % m).cast("double").alias(c) for c, m in (("x", 17), ("y", 23), ("z", 5))))
    return _rows(C.named(C.spatial(C.models(w.pages, w.mixed_edges, w.mixed), at, w.mixed)))


@query(sql("SELECT a, b, round(eb, 6) AS eb FROM passed", COMPS, EDGES, _shortest("member")))
def edge_betweenness(w: World) -> DataFrame:
    member = w.member.join(w.comps.select("root"), "root", "left_semi")
    return C.betweenness(w.pages, w.edges, member).select("a", "b", F.round("eb", 6).alias("eb"))


_SKELETON = """,
nodes AS (SELECT m.root, meaning, count(*) AS size, coalesce(min(title) FILTER (WHERE lang = 'AUTOMOBILE'), '') AS label FROM pages JOIN meanings m ON key = page_id WHERE redirect_id IS NULL GROUP BY m.root, meaning),
cuts AS (SELECT ma.root, least(ma.meaning, mb.meaning) AS m1, greatest(ma.meaning, mb.meaning) AS m2, count(*) AS n FROM edges JOIN meanings ma ON ma.page_id = a JOIN meanings mb ON mb.page_id = b WHERE ma.meaning <> mb.meaning GROUP BY 1, 2, 3)"""


def _meanings(w: World) -> DataFrame:
    return G.meanings(w.pages, w.parity)


def _skeleton(w: World) -> tuple[DataFrame, DataFrame]:
    english = w.pages.withColumn("lang", F.when(F.col("lang") == "AUTOMOBILE", "en").otherwise(F.col("lang")))
    return L.meaning_graph(english, _meanings(w), w.mixed_edges)


@query(sql("SELECT root AS comp_root, meaning, size, label FROM nodes", COMPS, PARITY, MEANINGS, EDGES, _SKELETON))
def meaning_graph(w: World) -> DataFrame:
    return _skeleton(w)[0].withColumnRenamed("root", "comp_root")


@query(sql("SELECT root AS comp_root, m1, m2, n FROM cuts", COMPS, PARITY, MEANINGS, EDGES, _SKELETON))
def meaning_links(w: World) -> DataFrame:
    return _skeleton(w)[1].withColumnRenamed("root", "comp_root")


@query(sql("SELECT m.root AS comp_root, meaning, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM meanings m JOIN positions USING (page_id) GROUP BY m.root, meaning", COMPS, PARITY, MEANINGS))
def meaning_centroids(w: World) -> DataFrame:
    return L.centroids(_meanings(w), w.positions).select(F.col("root").alias("comp_root"), "meaning", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(sql("SELECT root AS comp_root, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM positions GROUP BY root", COMPS, PARITY))
def bounding_box(w: World) -> DataFrame:
    return L.bounding_box(w.positions).withColumnRenamed("root", "comp_root")


#: Energy and gradient of springs along edges and repulsion between pages of one language, at positions by arithmetic.
_ENERGY = """,
ends AS (SELECT p.root, p.page_id AS i, q.page_id AS j, p.x - q.x AS dx, p.y - q.y AS dy, greatest(1e-6, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS r, CAST(weight AS DOUBLE) AS w FROM edges JOIN positions p ON p.page_id = a JOIN positions q ON q.page_id = b),
rivals AS (SELECT p.root, p.page_id AS i, q.page_id AS j, p.x - q.x AS dx, p.y - q.y AS dy, greatest(1e-6, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS r FROM positions p JOIN pages k ON k.key = p.page_id JOIN pages l ON l.lang = k.lang AND l.key > k.key JOIN positions q ON q.page_id = l.key AND q.root = p.root),
terms AS (SELECT root, i, j, w * pow(r - 1, 2) AS e, 2 * w * (r - 1) / r AS s, dx, dy FROM ends UNION ALL SELECT root, i, j, {e}, {s}, dx, dy FROM rivals),
slopes AS (SELECT root, i AS page_id, s * dx AS gx, s * dy AS gy FROM terms UNION ALL SELECT root, j, -s * dx, -s * dy FROM terms),
energies AS (SELECT root, sum(e) AS e FROM terms GROUP BY root), gradients AS (SELECT page_id, sum(gx) AS gx, sum(gy) AS gy FROM slopes GROUP BY page_id)"""


def _energy_sql(e: str, s: str) -> str:
    some = lambda c: f"round(coalesce({c}, 0), 4) + 0.0"
    return sql(f"SELECT p.root AS comp_root, p.page_id AS page_key, {some('e')} AS energy, {some('gx')} AS gx, {some('gy')} AS gy FROM positions p LEFT JOIN energies USING (root) LEFT JOIN gradients USING (page_id)", COMPS, PARITY, EDGES, _ENERGY.format(e=e, s=s))


def _energy_rows(w: World, alternative: bool) -> DataFrame:
    found = L.energy_at(w.pages, w.mixed_edges, w.positions, alternative)
    return found.select(F.col("root").alias("comp_root"), F.col("page_id").alias("page_key"), *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("energy", "gx", "gy")))


@query(_energy_sql("80 / r", "-80 / pow(r, 3)"))
def layout_energy(w: World) -> DataFrame:
    """The function and gradient that layouts descend along."""
    return _energy_rows(w, False)


@query(_energy_sql("80 * pow(r - 10, 2)", "160 * (r - 10) / r"))
def layout_energy_alternative(w: World) -> DataFrame:
    return _energy_rows(w, True)


IMPROVED = sql("SELECT root AS comp_root, true AS improved FROM comps WHERE NOT coherent AND root IN (SELECT root FROM parity)", COMPS, PARITY)


@query(sql("SELECT root AS comp_root, true AS improved FROM comps WHERE NOT coherent", COMPS))
def page_layout(w: World) -> DataFrame:
    found = L.page_positions(w.pages, w.mixed_edges, w.mixed)
    return found.groupBy(F.col("root").alias("comp_root")).agg((F.max("after") <= F.max("before") + 1e-9).alias("improved"))


@query(sql("SELECT root AS comp_root, true AS improved FROM comps WHERE NOT coherent", COMPS))
def page_layout_fast(w: World) -> DataFrame:
    found = L.page_positions(w.pages, w.mixed_edges, w.mixed, fast=True, alternative=True)
    return found.groupBy(F.col("root").alias("comp_root")).agg((F.max("after") <= F.max("before") + 1e-9).alias("improved"))


@query(IMPROVED)
def skeleton_layout(w: World) -> DataFrame:
    found = L.skeleton_positions(*_skeleton(w))
    return found.groupBy(F.col("root").alias("comp_root")).agg((F.max("after") <= F.max("before") + 1e-9).alias("improved"))


def _esc(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def _f6(x: str) -> str:
    return f"printf('%.6f', CAST({x} AS DOUBLE))"


def _line_sql(x1: str, y1: str, x2: str, y2: str, width: str) -> str:
    return f"""'  <line x1="' || {_f6(x1)} || '" y1="' || {_f6(y1)} || '" x2="' || {_f6(x2)} || '" y2="' || {_f6(y2)} || '" style="stroke-width: ' || {_f6(width)} || ';"/>' || chr(10)"""


def _drawing(scale: str, groups: list[tuple[str, str]]) -> str:
    """The whole text from ``box`` and tables (root, o, t) of each group."""
    parts = "".join(f""" || '<g style="{style}">' || chr(10) || coalesce((SELECT string_agg(t, '' ORDER BY o) FROM {items} WHERE {items}.root = box.root), '') || '</g>' || chr(10)""" for style, items in groups)
    return f"""SELECT root AS comp_root, '<?xml version="1.0"?>' || chr(10) || '<svg height="' || CAST(floor((y1 - y0) * {scale}) AS BIGINT) || '" width="' || CAST(floor((x1 - x0) * {scale}) AS BIGINT) || '">' || chr(10){parts} || '</svg>' || chr(10) AS svg FROM box"""


_PAGE_DRAWING = f""",
box AS (SELECT root, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM positions GROUP BY root),
at AS (SELECT p.*, meaning, (x - x0) * 100 AS px, (y - y0) * 100 AS py FROM positions p JOIN box USING (root) JOIN meanings USING (page_id)),
lines AS (SELECT p.root, [a, b] AS o, p.meaning = q.meaning AS inside, {_line_sql('p.px', 'p.py', 'q.px', 'q.py', '0.4 * weight')} AS t FROM edges JOIN at p ON p.page_id = a JOIN at q ON q.page_id = b),
inner_lines AS (SELECT * FROM lines WHERE inside), cut_lines AS (SELECT * FROM lines WHERE NOT inside),
circles AS (SELECT root, page_id AS o, '  <circle cx="' || {_f6('px')} || '" cy="' || {_f6('py')} || '" r="1.000000"/>' || chr(10) AS t FROM at),
labels AS (SELECT root, page_id AS o, '  <text x="' || {_f6('px + 1')} || '" y="' || {_f6('py + 1')} || '">' || {_esc("lang || ':' || title")} || '</text>' || chr(10) AS t FROM at JOIN pages ON key = page_id)""".replace("at AS (", "places AS (").replace("JOIN at ", "JOIN places ").replace("FROM at", "FROM places")
_GROUPS = [("stroke: lightgray;", "inner_lines"), ("stroke: red;", "cut_lines"), ("fill: lightgray; stroke: lightgray; stroke-width: 1;", "circles"), ("stroke: black; stroke-width: 0.1; font-size: 4pt;", "labels")]


@query(sql(_drawing("100", _GROUPS), COMPS, PARITY, EDGES, MEANINGS, _PAGE_DRAWING))
def svg_text(w: World) -> DataFrame:
    return V.component_svg(w.pages, w.mixed_edges, w.positions, _meanings(w)).withColumnRenamed("root", "comp_root")


_SKELETON_DRAWING = f""",
centres AS (SELECT m.root, meaning, avg(x) AS x, avg(y) AS y FROM meanings m JOIN positions USING (page_id) GROUP BY m.root, meaning),
box AS (SELECT root, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM centres GROUP BY root),
places AS (SELECT c.*, (x - x0) * 12 AS px, (y - y0) * 12 AS py FROM centres c JOIN box USING (root)),
intra AS (SELECT ma.root, ma.meaning AS m1, ma.meaning AS m2, count(*) AS n FROM edges JOIN meanings ma ON ma.page_id = a JOIN meanings mb ON mb.page_id = b WHERE ma.meaning = mb.meaning GROUP BY 1, 2, 3),
cut_lines AS (SELECT c.root, [m1, m2] AS o, {_line_sql('p.px', 'p.py', 'q.px', 'q.py', '0.4 * ln(1 + n)')} AS t FROM (SELECT * FROM cuts UNION ALL SELECT * FROM intra) c JOIN places p ON p.root = c.root AND p.meaning = m1 JOIN places q ON q.root = c.root AND q.meaning = m2),
circles AS (SELECT root, meaning AS o, '  <circle cx="' || {_f6('px')} || '" cy="' || {_f6('py')} || '" r="' || {_f6('sqrt(size)')} || '"/>' || chr(10) AS t FROM places JOIN nodes USING (root, meaning)),
labels AS (SELECT root, meaning AS o, '  <text x="' || {_f6('px - 1')} || '" y="' || {_f6('py - 1')} || '">' || {_esc('label')} || '</text>' || chr(10) AS t FROM places JOIN nodes USING (root, meaning))"""


@query(sql(_drawing("12", _GROUPS[1:]), COMPS, PARITY, MEANINGS, EDGES, _SKELETON, _SKELETON_DRAWING))
def skeleton_svg_text(w: World) -> DataFrame:
    """At the meanings' centres, with the edges inside meanings."""
    nodes, links = _skeleton(w)
    inside = L.meaning_inside(_meanings(w), w.mixed_edges)
    return V.skeleton_svg(nodes, links, L.centroids(_meanings(w), w.positions), inside).withColumnRenamed("root", "comp_root")


@query(sql("""SELECT root AS comp_root, string_agg(name, ' + ' ORDER BY name) AS name FROM (SELECT p.root, regexp_replace(title, '[^a-zA-Z0-9]', '_', 'g') AS name FROM positions p JOIN pages ON key = page_id
    WHERE lang = 'AUTOMOBILE') GROUP BY root""", COMPS, PARITY))  # fmt: skip
def svg_names(w: World) -> DataFrame:
    english = w.pages.withColumn("lang", F.when(F.col("lang") == "AUTOMOBILE", "en").otherwise(F.col("lang")))
    return V.svg_names(V.component_svg(english, w.mixed_edges, w.positions, _meanings(w))).withColumnRenamed("root", "comp_root")


def _xml(w: World, with_common: bool = False) -> DataFrame:
    ids = w.comps.select("root", F.col("root").alias("comp_id"), "namespace")
    edges = G.weighted(w.edges, G.common_categories(w.edges, w.cats, w.links))
    return V.partition_xml(w.pages, w.links, edges, _meanings(w), ids, with_common)


_XML = f""",
ends AS (SELECT l.src_id, l.dst_id, p.redirect_id, coalesce(p.redirect_id, l.dst_id) AS e FROM langlinks l LEFT JOIN pages p ON p.key = l.dst_id),
ties AS (SELECT m1.root, m1.meaning AS m1, m2.meaning AS m2, src_id, dst_id, chr(9) || chr(9) || '<link common="' || CASE WHEN redirect_id IS NOT NULL THEN 0 ELSE coalesce(n, 0) END || '" from="' || {_esc('src_id')} || '" to="' || {_esc('dst_id')} || '"/>' || chr(10) AS t
    FROM ends JOIN meanings m1 ON m1.page_id = src_id JOIN meanings m2 ON m2.page_id = e LEFT JOIN shared ON shared.a = least(src_id, e) AND shared.b = greatest(src_id, e)),
rows_of AS (SELECT m.root, meaning, 0 AS k, key AS a, '' AS b, chr(9) || chr(9) || '<page id="' || {_esc('key')} || '" lang="' || {_esc('lang')} || '"' || coalesce(' redirect="' || {_esc('redirect_id')} || '"', '') || ' title="' || {_esc('title')} || '"/>' || chr(10) AS t FROM meanings m JOIN pages ON key = page_id
    UNION ALL SELECT root, m1, 1, src_id, dst_id, t FROM ties WHERE m1 = m2),
clusters AS (SELECT root, meaning, chr(9) || '<cluster id="' || meaning || '">' || chr(10) || string_agg(t, '' ORDER BY k, a, b, t) || chr(9) || '</cluster>' || chr(10) AS t FROM rows_of GROUP BY root, meaning),
inner_text AS (SELECT root, string_agg(t, '' ORDER BY meaning) AS t FROM clusters GROUP BY root),
cut_text AS (SELECT root, string_agg(t, '' ORDER BY src_id, dst_id, t) AS t FROM ties WHERE m1 <> m2 GROUP BY root)"""


@query(sql("""SELECT root AS comp_root, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<component id="' || root || '" namespace="' || namespace || '">' || chr(10) || i.t
    || coalesce(chr(9) || '<incoherent>' || chr(10) || c.t || chr(9) || '</incoherent>' || chr(10), chr(9) || '<incoherent/>' || chr(10)) || '</component>' || chr(10) AS xml
    FROM inner_text i JOIN comps USING (root) LEFT JOIN cut_text c USING (root)""", COMPS, PARITY, MEANINGS, EDGES, COMMON, _XML))  # fmt: skip
def partition_xml(w: World) -> DataFrame:
    return _xml(w, True).withColumnRenamed("root", "comp_root")


_CLASH = """,
told AS (SELECT m.root, m.meaning, lang, title FROM meanings m JOIN pages ON key = page_id WHERE redirect_id IS NULL),
clashing AS (SELECT root FROM told GROUP BY root, meaning, lang HAVING count(*) > 1)"""


@query(sql("""SELECT root AS comp_id, CAST(dense_rank() OVER (PARTITION BY root ORDER BY meaning) - 1 AS INTEGER) AS cluster_no, lang, title, langs FROM told
    JOIN (SELECT root, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM told GROUP BY root) USING (root) WHERE root NOT IN (SELECT root FROM clashing)""", COMPS, PARITY, MEANINGS, _CLASH))  # fmt: skip
def xml_read(w: World) -> DataFrame:
    parsed = V.parse_partition(_xml(w))
    langs = parsed.select("comp_id", F.array_join("langs", ",").alias("langs"))
    return V.cluster_pages(parsed).drop("namespace").join(langs, "comp_id")


@query(sql("SELECT root AS comp_id, CAST(CASE WHEN root IN (SELECT root FROM clashing) THEN 0 ELSE count(DISTINCT meaning) END AS INTEGER) AS n_clusters, CAST(CASE WHEN root IN (SELECT root FROM clashing) THEN 0 ELSE count(DISTINCT lang) END AS INTEGER) AS n_langs FROM told GROUP BY root", COMPS, PARITY, MEANINGS, _CLASH))
def xml_incoherent_guard(w: World) -> DataFrame:
    return V.parse_partition(_xml(w)).select("comp_id", F.size("clusters").alias("n_clusters"), F.size("langs").alias("n_langs"))


# What the partition says (one page of each language in each cluster) against links made by arithmetic.
_BOT = """,
members AS (SELECT root || ' ' || cluster AS cluster, lang, min(title) AS title FROM pages JOIN parity USING (key) GROUP BY 1, 2),
n AS (SELECT *, length(title) + ascii(right(title, 1)) AS k FROM members),
live_links AS (SELECT a.lang, a.title, b.lang AS to_lang, CASE WHEN b.k % 3 = 0 THEN b.title || '?' ELSE b.title END AS to_title FROM n a JOIN n b ON a.cluster = b.cluster AND a.lang <> b.lang WHERE (a.k + b.k) % 2 = 0
    UNION ALL SELECT lang, title, 'gone', 'x' FROM n WHERE k % 5 = 0),
want AS (SELECT a.cluster, a.lang, a.title, b.lang AS to_lang, b.title AS target FROM members a JOIN members b USING (cluster) WHERE a.lang <> b.lang),
changes AS (SELECT coalesce(w.cluster, h.cluster) AS cluster, coalesce(w.lang, h.lang) AS lang, coalesce(w.title, h.title) AS title, coalesce(w.to_lang, h.to_lang) AS to_lang,
    CASE WHEN target IS NULL THEN 'remove' WHEN to_title IS NULL THEN 'add' WHEN to_title <> target THEN 'change' END AS action, target
    FROM want w FULL JOIN (SELECT m.cluster, l.* FROM members m JOIN live_links l ON m.lang = l.lang AND m.title = l.title) h ON w.cluster = h.cluster AND w.lang = h.lang AND w.title = h.title AND w.to_lang = h.to_lang)"""


def _members(w: World) -> DataFrame:
    return w.pages.join(w.parity, "key").groupBy(F.concat_ws(" ", "root", "cluster").alias("cluster"), "lang").agg(F.min("title").alias("title"))


def _live(w: World) -> DataFrame:
    n = _members(w).withColumn("k", F.length("title") + F.ascii(F.right("title", F.lit(1))))
    a, b = n.alias("a"), n.alias("b")
    pair = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.lang") != F.col("b.lang")) & ((F.col("a.k") + F.col("b.k")) % 2 == 0))
    to = F.when(F.col("b.k") % 3 == 0, F.concat("b.title", F.lit("?"))).otherwise(F.col("b.title"))
    some = pair.select("a.lang", "a.title", F.col("b.lang").alias("to_lang"), to.alias("to_title"))
    return some.union(n.where("k % 5 = 0").select("lang", "title", F.lit("gone"), F.lit("x")))


@query(sql("SELECT * FROM changes WHERE action IS NOT NULL", COMPS, PARITY, _BOT))
def reconcile_changes(w: World) -> DataFrame:
    return B.changes(_members(w), _live(w))


@query(sql("""SELECT lang, title, 'Interwiki analysis' || concat_ws(',', ' adding: (' || string_agg(to_lang, ', ' ORDER BY to_lang) FILTER (WHERE action = 'add') || ')',
    ' changing: (' || string_agg(to_lang, ', ' ORDER BY to_lang) FILTER (WHERE action = 'change') || ')', ' removing: (' || string_agg(to_lang, ', ' ORDER BY to_lang) FILTER (WHERE action = 'remove') || ')') AS summary
    FROM changes WHERE action IS NOT NULL GROUP BY lang, title""", COMPS, PARITY, _BOT))  # fmt: skip
def reconcile_summary(w: World) -> DataFrame:
    return B.summaries(B.changes(_members(w), _live(w)))


_GUARD = """,
state AS (SELECT *, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 11 = 0 END AS is_redirect FROM n WHERE lang <> 'BUILDING')"""


@query(sql("SELECT cluster, lang, title FROM state WHERE cluster NOT IN (SELECT cluster FROM state WHERE is_redirect IS NULL OR is_redirect)", COMPS, PARITY, _BOT, _GUARD))
def reconcile_guard(w: World) -> DataFrame:
    m = _members(w)
    k = F.length("title") + F.ascii(F.right("title", F.lit(1)))
    live = m.where(k % 7 != 0).select("lang", "title", (k % 11 == 0).alias("is_redirect")).distinct()
    return B.guarded(m, live, m.where("lang <> 'BUILDING'").select("lang"))
