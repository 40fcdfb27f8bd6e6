"""Small graphs with answers worked out by hand."""

import re
import uuid

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossweave.functions.keys import DNS, OID, URL, uuid5
from glossweave.operators import clustering as C
from glossweave.operators import graph as G
from glossweave.operators import ingest as I
from glossweave.operators import layout as L
from glossweave.operators import reconcile as B
from glossweave.operators import render as V
from glossweave.operators.components import connected_components
from glossweave.plans import ingest_queries
from glossweave.sources import dumps, store

G1 = [("de:1", "en:1"), ("de:1", "en:1"), ("de:1", "fr:1"), ("en:2", "fr:1"), ("en:2", "pl:1"), ("en:2", "pl:1")]


def component(links, key="c"):
    w = {}
    for a, b in links:
        w[min(a, b), max(a, b)] = w.get((min(a, b), max(a, b)), 0.0) + 1.0
    keys = sorted({k for e in w for k in e})
    pages = pd.DataFrame({"key": keys, "lang": [k.split(":")[0] for k in keys]})
    return C.build(key, pages, pd.DataFrame([(a, b, x) for (a, b), x in w.items()], columns=["a", "b", "weight"]))


def named(comp, of):
    out = {}
    for v, i in enumerate(of):
        out.setdefault(i, set()).add(comp.pages[v])
    return {frozenset(s) for s in out.values()}


def eb(comp):
    return {(comp.pages[a], comp.pages[b]): x for (a, b, _), x in zip(comp.edges, C.edge_betweenness(len(comp.pages), comp.edges), strict=True)}


def pages_of(spark, rows):
    return spark.createDataFrame([(k, k.split(":")[0], 0, f"T {k}", r) for k, r in rows], "key string, lang string, namespace int, title string, redirect_id string")


def links_of(spark, rows):
    return spark.createDataFrame(rows, "src_id string, dst_id string")


def test_g1_betweenness_and_newman_girvan():
    c = component(G1)
    assert eb(c) == {("de:1", "en:1"): 8, ("de:1", "fr:1"): 12, ("en:2", "fr:1"): 12, ("en:2", "pl:1"): 8}
    want = {frozenset({"de:1", "en:1", "fr:1"}), frozenset({"en:2", "pl:1"})}
    for engine in (C.by_betweenness, C.newman_girvan, C.Genetic()):
        of, cost = engine(c)
        assert named(c, of) == want and cost == 1


def test_g1_components_and_keys(spark):
    pages = pages_of(spark, [("de:1", None), ("en:1", None), ("en:2", None), ("fr:1", None), ("pl:1", None)])
    links = links_of(spark, [("en:1", "de:1"), ("de:1", "en:1"), ("de:1", "fr:1"), ("fr:1", "en:2"), ("en:2", "pl:1"), ("pl:1", "en:2")])
    member = G.membership(pages, links)
    r = G.components(pages, member).collect()
    assert [(x["size"], x["coherent"], x["n_langs"]) for x in r] == [(5, False, 4)]
    assert G.component_keys(member).first()["comp_id"] == "7ada7ca4-97b2-57f4-aca8-590dded92ae1"
    w = {(x["a"], x["b"]): x["weight"] for x in G.edges(pages, links).collect()}
    assert w == {("de:1", "en:1"): 2, ("de:1", "fr:1"): 1, ("en:2", "fr:1"): 1, ("en:2", "pl:1"): 2}
    found = C.clusters(pages, G.edges(pages, links), member, "analysis.betweenness")
    ids = {x["page_id"]: x["meaning"] for x in G.meanings(pages, found).collect()}
    assert ids["fr:1"] == ids["en:1"] == "02904b95-ebfb-59ae-a961-8399dacbedc3" and ids["pl:1"] == "ae903a93-9aa9-514e-970f-a0205120312c"


def test_g2_redirects(spark):
    pages = pages_of(spark, [("en:1", None), ("en:9", "en:1"), ("de:1", None)])
    links = links_of(spark, [("de:1", "en:9"), ("en:1", "de:1")])
    member = G.membership(pages, links)
    r = G.components(pages, member).first()
    assert (r["size"], r["coherent"]) == (2, True)
    assert G.component_keys(member).first()["comp_id"] == "e0f2fdda-8514-56b5-a705-e71ecb5e2235"
    assert G.component_keys(member, "dns").first()["comp_id"] == "46e479ff-aa8f-5725-b2e6-e7e73552916b"
    e = G.edges(pages, links)
    assert [(x["a"], x["b"], round(x["weight"], 9)) for x in e.collect()] == [("de:1", "en:1", 1.1)]
    cats = spark.createDataFrame([("de:1", "en:1", 2)], "a string, b string, n long")
    assert round(G.weighted(e, cats).first()["weight"], 6) == 2.231371
    found = C.clusters(pages, e, member, "analysis.cliques")
    m = G.meanings(pages, found).collect()
    assert {x["meaning"] for x in m} == {"39996ff4-4f11-50b6-a887-bc19219eae7a"} and len(m) == 3


def test_g3_single_pages_are_dropped(spark):
    pages = pages_of(spark, [("en:5", None), ("en:6", "en:5")])
    member = G.membership(pages, links_of(spark, []))
    assert G.components(pages, member).count() == 0 and G.components(pages, member, drop_singletons=False).first()["size"] == 1


@pytest.mark.parametrize(("policy", "left"), [("middle", {"en:1": "en:2"}), ("source", {"en:3": "en:4"})])
def test_g4_chains(spark, policy, left):
    pages = pages_of(spark, [("en:1", "en:2"), ("en:2", "en:3"), ("en:3", "en:4"), ("en:4", None)])
    got = {r["key"]: r["redirect_id"] for r in I.remove_double_redirects(pages, policy).collect() if r["redirect_id"]}
    assert got == left


def test_g5_bridge():
    c = component([("en:1", "de:1"), ("de:1", "fr:1"), ("en:1", "fr:1"), ("fr:1", "en:2"), ("en:2", "pl:1"), ("pl:1", "it:1"), ("en:2", "it:1")])
    got = eb(c)
    assert got.pop(("en:2", "fr:1")) == 18 and got.pop(("de:1", "en:1")) == 2 and got.pop(("it:1", "pl:1")) == 2 and set(got.values()) == {8.0}


def test_g6_cliques():
    five = ["en:1", "de:1", "fr:1", "pl:1", "it:1"]
    c = component([(a, b) for i, a in enumerate(five) for b in five[i + 1 :]] * 2 + [("en:2", "de:1")])
    of, cost = C.cliques(c)
    assert named(c, of) == {frozenset(five), frozenset({"en:2"})} and cost == 1


def test_g7_cycle():
    assert set(eb(component([("a:1", "b:1"), ("b:1", "c:1"), ("c:1", "d:1"), ("d:1", "a:1")])).values()) == {4.0}


def test_g8_incoherent_partition(spark):
    page = '<page id="k" lang="{}" title="{}"/>'
    xml = '<?xml version="1.0" encoding="UTF-8"?>\n<component id="x" namespace="0"><cluster id="m">' + page.format("en", "A &amp; B") + page.format("de", "C") + "</cluster>{}<incoherent/></component>"
    bad = xml.format("<cluster>" + page.format("en", "D") + page.format("en", "E") + "</cluster>")
    good = xml.format('<cluster><page lang="fr" title="F"/><page lang="fr" title="G" redirect="fr:1"/></cluster>')
    got = V.parse_partition(spark.createDataFrame([(bad,), (good,)], "xml string")).collect()
    assert got[0]["clusters"] == [] and got[0]["langs"] == []
    assert got[1]["langs"] == ["de", "en", "fr"]
    assert [[(p["lang"], p["title"]) for p in c] for c in got[1]["clusters"]] == [[("en", "A & B"), ("de", "C")], [("fr", "F")]]


def test_g9_reconcile(spark):
    members = spark.createDataFrame([("k", "en", "E"), ("k", "id", "I"), ("k", "it", "T")], "cluster string, lang string, title string")
    live = spark.createDataFrame([("en", "E", "id", "I"), ("en", "E", "it", "wrong"), ("en", "E", "fr", "F")], "lang string, title string, to_lang string, to_title string")
    found = B.changes(members, live)
    assert {(r["to_lang"], r["action"], r["target"]) for r in found.where("lang = 'en'").collect()} == {("it", "change", "T"), ("fr", "remove", None)}
    assert found.where("lang = 'id' and action = 'add'").count() == 2
    assert B.summaries(found).where("lang = 'en'").first()["summary"] == "Interwiki analysis changing: (it), removing: (fr)"


def test_uuids(spark):
    names = ["", "a", "é#ß", "x" * 500]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for hexed, ns in ((OID, uuid.NAMESPACE_OID), (DNS, uuid.NAMESPACE_DNS), (URL, uuid.NAMESPACE_URL)):
        assert {r[0]: r[1] for r in df.select("n", uuid5(hexed, F.col("n"))).collect()} == {n: str(uuid.uuid5(ns, n)) for n in names}


def test_dump_lines(spark):
    line = r"""INSERT INTO `page` VALUES (1,0,'It\'s_a','x'),(2,14,'a\\',NULL),(-3,0,"dou,ble)",''),(4,0,'n\n','(');"""
    rows = [(line,), ("-- INSERT INTO",), ("",)]
    df = spark.createDataFrame(rows, "value string")
    got = [r["fields"] for r in dumps.records(df).collect()]
    assert got == [["1", "0", "It's a", "x"], ["2", "14", "a\\", "NULL"], ["-3", "0", "dou,ble)", ""], ["4", "0", "n\\n", "("]]


def test_bare_fields_and_malformed_records(spark):
    df = spark.createDataFrame([("INSERT INTO `x` VALUES (1,ab'c,2),(3,'ok'),(,);",), ("INSERT INTO `x` VALUES (1,'a'),(2,'a'b),(3,'c');",), ("INSERT INTO `x` VALUES (1,'a'),(2,'open",)], "value string")
    got = [r["fields"] for r in dumps.records(df).collect()]
    assert got == [["1", "ab'c", "2"], ["3", "ok"], ["", ""], ["1", "a"], ["3", "c"], ["1", "a"]]
    assert [r["rest"] for r in dumps.malformed(df).collect()] == ["INSERT INTO `x` VALUES ,(2,'a'b),;", "INSERT INTO `x` VALUES ,(2,'open"]
    assert dumps.records(df.limit(1), strict=True).count() == 3
    with pytest.raises(Exception, match="malformed record"):
        dumps.records(df, strict=True).collect()


def test_lines_are_not_copied_to_their_records(spark):
    df = spark.createDataFrame([("xx", b"INSERT INTO `x` VALUES (1,'a'),(2,'\xff'),(3,'b');"), ("yy", "INSERT INTO `x` VALUES (4,'\ufffd');".encode()), ("zz", None)], "lang string, value binary")
    for strict in (False, True):
        found = dumps.records(df.selectExpr("lang", "cast(value as string) as value").repartition(1), strict=strict)
        plan = found._jdf.queryExecution().executedPlan().toString()
        carried = re.findall(r"\[([^\[\]]*)\], false, \[__record#\d+\]", plan)
        assert carried and not any("value" in c for c in carried)
        assert sorted((r["lang"], *r["fields"]) for r in found.collect()) == [("xx", "1", "a"), ("xx", "3", "b"), ("yy", "4", "\ufffd")]


def test_dump_lines_keep_their_length(spark, tmp_path):
    spark.range(60_000).selectExpr("id as c_custkey", "concat('c_', id) as c_name", "3 as c_nationkey", "'m' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    sizes = [r["n"] for r in ingest_queries._lines(spark, str(tmp_path)).selectExpr("size(split(value, ',0,')) - 1 as n").collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= ingest_queries._A_LINE
    got = ingest_queries.dump_roundtrip(spark, str(tmp_path))
    assert got.count() == 60_000 and got.where("title = concat('c ', page_id, ' (a,b)', chr(39), chr(34), chr(92), 'm')").count() == 60_000


def test_undivided_dumps_are_split_and_read_back(spark, tmp_path):
    text = "INSERT INTO `lost` VALUES (0);\n" + "".join(f"-- Table structure for table `{t}`\nCREATE\nINSERT INTO `{t}` VALUES ({k},0,'{t}_{k}');\nINSERT INTO `{t}` VALUES (9,0,'z');\n" for k, t in enumerate(("page", "page_props", "redirect")))
    for lang in ("pt_br", "de"):
        (tmp_path / f"{lang}toys.sql").write_text(text)
    split = dumps.split_by_table(dumps.read_whole(spark, str(tmp_path), "toys"))
    dumps.write_split(split, str(tmp_path / "out"))
    lines = dumps.read_lines(spark, str(tmp_path / "out"))
    assert {(r["lang"], r["table"]) for r in lines.collect()} == {(g, t) for g in ("de", "pt-br") for t in ("page", "redirect")}
    assert sorted(r["title"] for r in dumps.read_table(lines, "page").where("lang = 'de'").collect()) == ["page 0", "page props 1", "z", "z"]
    found = dumps.files(spark, str(tmp_path / "out"))
    dumps.require(found, ("page", "redirect"))
    with pytest.raises(FileNotFoundError, match="de: langlinks, pt-br: langlinks"):
        dumps.require(found, ("page", "langlinks"))


def test_dump_files(spark, tmp_path):
    import gzip

    raw = b"INSERT INTO `page` VALUES (1,0,'ok'),(2,0,'bad\xff'),(3,0,'fine');\nCREATE TABLE\n"
    for name in ("pt_brwiki-20240101-page.sql.gz", "pt_brwiki-20230101-page.sql.gz", "dewiki-20240101-page.sql.gz", "dewiki-20240101-langlinks.sql.gz"):
        with gzip.open(tmp_path / name, "wb") as f:
            f.write(raw if "2024" in name else raw.replace(b"ok", b"old"))
    lines = dumps.read_lines(spark, str(tmp_path))
    assert [r["lang"] for r in dumps.languages(lines).collect()] == ["de", "pt-br"]
    got = sorted((r["lang"], r["page_id"], r["title"]) for r in dumps.read_table(lines, "page").collect())
    assert got == [("de", "1", "ok"), ("de", "3", "fine"), ("pt-br", "1", "ok"), ("pt-br", "3", "fine")]
    assert dumps.empty(spark, "page").count() == 0


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "m")
    df = lambda rows: spark.createDataFrame(rows, "auth string, comp_id string, page_id string")
    store.replace_partitions(df([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z")]), path, ["auth", "comp_id"])
    store.replace_partitions(df([("a", "1", "n")]), path, ["auth", "comp_id"])
    assert sorted((r["auth"], str(r["comp_id"]), r["page_id"]) for r in spark.read.parquet(path).collect()) == [("a", "1", "n"), ("a", "2", "y"), ("b", "1", "z")]


def test_components_on_chains_and_random_graphs(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(300)] + [(int(a), int(b)) for a, b in rng.integers(400, 900, (250, 2))] + [(7, 7), (1000, 1000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["id"]: r["root"] for r in connected_components(df).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


graphs = st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), min_size=1, max_size=30).map(lambda e: [(f"{'abcd'[x % 4]}:{x}", f"{'abcd'[y % 4]}:{y}") for x, y in e if x != y]).filter(bool)


@settings(max_examples=30, deadline=None)
@given(graphs)
def test_every_engine_gives_valid_clusters(links):
    c = component(links)
    for engine in C.ENGINES.values():
        of, cost = engine(c)
        assert np.isclose(cost, c.weight(of))
        for own in named(c, of):
            langs = [p.split(":")[0] for p in own]
            assert len(langs) == len(set(langs))
        assert engine(component(links[::-1])) == (of, cost)


@settings(max_examples=10, deadline=None)
@given(graphs)
def test_fitness_never_falls(links):
    _, history = C.Genetic(generation=20, fresh=4, patience=3).search(component(links))
    assert history == sorted(history)


@settings(max_examples=15, deadline=None)
@given(graphs, st.booleans())
def test_gradient_against_differences(links, alternative):
    c = component(links)
    energy = L.page_energy(c, alternative)
    x = np.random.default_rng(0).uniform(-5, 5, 2 * len(c.pages))
    _, g = energy(x)
    for i in range(len(x)):
        d = np.zeros_like(x)
        d[i] = 1e-5
        assert np.isclose(g[i], (energy(x + d)[0] - energy(x - d)[0]) / 2e-5, rtol=1e-3, atol=1e-2)


def test_native_fold_equals_python(spark):
    rng = np.random.default_rng(2)
    links = [(f"{'abcd'[x % 4]}:{x}", f"{'abcd'[y % 4]}:{y}") for x, y in rng.integers(0, 15, (40, 2)).tolist() if x != y]
    pages = pages_of(spark, [(k, None) for k in sorted({k for e in links for k in e})])
    edges = G.edges(pages, links_of(spark, links))
    member = pages.select("key", F.lit("r").alias("root"))
    got = C.random_costs(C.models(pages, edges, member), 3).collect()
    c = C.build("r", pages.select("key", "lang").toPandas(), edges.toPandas())
    h = {(r["seed"], r["a"], r["b"]): r["h"] for r in edges.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("seed"))).select("seed", "a", "b", F.md5(F.concat_ws("|", F.col("seed").cast("string"), "a", "b")).alias("h")).collect()}
    for r in got:
        order = sorted(range(len(c.edges)), key=lambda k: h[r["seed"], c.pages[c.edges[k][0]], c.pages[c.edges[k][1]]])
        own, cost = C.greedy(c, order)
        clusters = {}
        for n in r["nodes"]:
            clusters.setdefault(n["c"], set()).add(n["k"])
        assert named(c, own.of) == {frozenset(s) for s in clusters.values()} and np.isclose(cost, r["cost"])


def test_no_large_component_is_dropped(spark):
    # a chain of 310 pages and one of 6
    links = [(f"{'abcd'[x % 4]}:{x:03}", f"{'abcd'[(x + 1) % 4]}:{x + 1:03}") for x in [*range(309), *range(400, 405)]]
    keys = sorted({k for e in links for k in e})
    pages = pages_of(spark, [(k, None) for k in keys])
    edges = G.edges(pages, links_of(spark, links))
    member = pages.select("key", F.when(F.substring("key", 3, 3) < "400", "r").otherwise("s").alias("root"))
    at = pages.select(F.col("key").alias("page_id"), *(F.substring("key", 3, 3).cast("double").alias(c) for c in "xyz"))
    model = C.models(pages, edges, member)

    def nodes(df):
        return {(r["root"], n["k"]) for r in df.collect() for n in r["nodes"]}

    everything = {("r" if k[2:] < "400" else "s", k) for k in keys}
    assert nodes(C.random_costs(model, 1)) == everything and nodes(C.spatial(model, at, member)) == everything
    # both ways give the same
    small = model.where("root = 's'")
    for found in (lambda n: C.random_costs(small, 4, n), lambda n: C.spatial(small, at, member, n)):
        native, python = (sorted(map(str, found(n).collect())) for n in (300, 2))
        assert native == python
    with pytest.raises(Exception, match="more than 100"):
        C.random_costs(C.models(pages, edges, member, 100), 1).collect()


def test_merging_languages_twice_is_refused():
    c = C.Clusters(["en", "en", "de"])
    with pytest.raises(ValueError, match="language"):
        c.merge(0, 1)
    c.merge(0, 2)
    c.merge(0, 1, force=True)
    assert set(c.of) == {0}


def test_edge_betweenness_of_every_component(spark, sf):
    from glossweave.plans import registry

    brute = {}
    arcs = {}
    got = {(r["a"], r["b"]): r["eb"] for r in registry.QUERIES["edge_betweenness"](spark, sf).collect()}
    for a, b in got:
        arcs.setdefault(a, set()).add(b)
        arcs.setdefault(b, set()).add(a)
    edges = {(r["a"], r["b"]) for r in registry.QUERIES["canonical_edges"](spark, sf).select("a", "b").collect()}
    assert set(got) == edges
    sizes = set()
    for s in arcs:
        level, found = {s: [[s]]}, {s: [[s]]}
        while level:
            after = {}
            for u, ways in level.items():
                for v in arcs[u] - found.keys():
                    after.setdefault(v, []).extend([*way, v] for way in ways)
            found |= after
            level = after
        sizes.add(len(found))
        for t, ways in found.items():
            for way in ways:
                for e in zip(way, way[1:], strict=False):
                    brute[tuple(sorted(e))] = brute.get(tuple(sorted(e)), 0) + 1 / len(ways)
    assert max(sizes) > 8
    assert all(abs(got[e] - x) < 1e-5 for e, x in brute.items()) and brute.keys() == got.keys()


def test_single_pages_are_no_valid_clusters(spark):
    links = [("en:1", "de:1"), ("de:1", "en:2"), ("en:2", "fr:1")]
    pages = pages_of(spark, [(k, None) for k in ("en:1", "de:1", "en:2", "fr:1")])
    edges = G.edges(pages, links_of(spark, links))
    member = pages.select("key", F.lit("r").alias("root"))
    alone = pages.select(F.lit("r").alias("root"), "key", F.col("key").alias("cluster"), F.lit(3.0).alias("cost"))
    assert [tuple(r) for r in C.validity(alone, pages, edges, member).collect()] == [("r", 4, 0, 0.0, 3)]
    found = C.clusters(pages, edges, member, "analysis.cliques")
    assert [tuple(r) for r in C.validity(found, pages, edges, member).collect()] == [("r", 4, 0, 0.0, 0)]
