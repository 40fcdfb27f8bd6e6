import gzip
import xml.etree.ElementTree as ET

import pytest

from glossweave.operators import render as V
from glossweave.plans import cli
from glossweave.sources import store


def _dump(path, lang, table, rows):
    with gzip.open(path / f"{lang}wiki-20240101-{table}.sql.gz", "wt") as f:
        f.write(f"INSERT INTO `{table}` VALUES {','.join(rows)};\n")


def test_from_dumps_to_partitions(spark, tmp_path):
    dumps, db, out = tmp_path / "dumps", tmp_path / "db", tmp_path / "out"
    dumps.mkdir()
    pages = {"en": ["(1,0,'One')", "(2,0,'Two')", "(3,14,'Numbers')", "(4,4,'Talk')"], "de": ["(1,0,'Eins')", "(9,0,'Neun')"], "fr": ["(1,0,'Un')"]}
    links = {"en": ["(1,'de','Eins')", "(2,'de','Eins')", "(1,'fr','Un')"], "de": ["(1,'en','One')"], "fr": ["(1,'de','Eins')"]}
    for lang in pages:
        _dump(dumps, lang, "page", pages[lang])
        _dump(dumps, lang, "langlinks", links[lang])
        _dump(dumps, lang, "redirect", ["(9,0,'Eins')"] if lang == "de" else ["(77,0,'x')"])
        _dump(dumps, lang, "categorylinks", ["(1,'Numbers')"])
    _dump(dumps, "en", "pagelinks", ["(1,0,'Two')", "(1,0,'Gone')"])
    run = lambda *a: cli.main(["-d", str(db), "-u", "me", "-i", str(dumps), "-o", str(out), *a], spark)
    run("-r", "import,find-comps,unknown")
    run("-r", "find-comps")  # once more: replaces
    assert [tuple(r) for r in spark.read.parquet(f"{db}/pagelinks").collect()] == [("en:1", "en:2")]
    assert spark.read.parquet(f"{db}/rejected").agg({"n": "sum"}).first()[0] >= 2
    assert [(r["size"], r["coherent"]) for r in spark.read.parquet(f"{db}/components").collect()] == [(4, False)]
    log = run("-s", "batch,common-cats,fast-pos,timing", "-r", "positions,random,stats,cliques,spatial,betweenness,newman-girvan,genetic,visualize,skel-vis,serialize")
    assert ("stats", 1) in log and [tuple(r)[1:] for r in spark.read.parquet(f"{db}/log/stats").collect()] == [(4, 4)]
    got = spark.read.parquet(f"{db}/meanings")
    assert {r["auth"] for r in got.select("auth").distinct().collect()} == {f"analysis.{a}" for a in ("cliques", "spatial", "betweenness", "newman-girvan", "genetic")}
    files = {r["file"]: r["text"] for r in V.read_sharded(spark, f"{out}/xml").collect()}
    assert len(files) == 1
    name, xml = files.popitem()
    root = ET.fromstring(xml)
    assert name == f"{root.get('id')}.xml" and len(root.findall("cluster")) == 2 and root.find("incoherent") is not None
    pages = {p.get("id"): p for p in root.iter("page")}
    assert set(pages) == {"en:1", "en:2", "de:1", "de:9", "fr:1"} and pages["de:9"].get("redirect") == "de:1" and pages["en:1"].get("title") == "One"
    assert {(l.get("from"), l.get("to")) for l in root.iter("link")} == {("en:1", "de:1"), ("en:2", "de:1"), ("en:1", "fr:1"), ("de:1", "en:1"), ("fr:1", "de:1")}
    assert all(l.get("common") is not None for l in root.iter("link"))
    for kind in ("svg", "skeleton"):
        assert all(ET.fromstring(r["text"]).tag == "svg" for r in V.read_sharded(spark, f"{out}/{kind}").collect())
    # live links against the partitions
    spark.createDataFrame([("en", "One", False), ("en", "Two", False), ("de", "Eins", False), ("fr", "Un", False)], "lang string, title string, is_redirect boolean").write.parquet(f"{db}/live_pages")
    spark.createDataFrame([("en", "One", "de", "Eins"), ("en", "One", "xx", "X")], "lang string, title string, to_lang string, to_title string").write.parquet(f"{db}/live_links")
    log = run("-f", f"{out}/xml", "-n", "-v", "-r", "reconcile")
    assert dict(log[:2])["clusters"] == (2, 2) and not (out / "changes").exists()
    run("-f", f"{out}/xml", "-r", "reconcile")
    found = {(r["lang"], r["to_lang"], r["action"]) for r in spark.read.parquet(f"{out}/changes").where("title = 'One'").collect()}
    assert ("en", "xx", "remove") in found and ("en", "fr", "add") in found
    assert "removing: (xx)" in spark.read.parquet(f"{out}/summaries").where("title = 'One'").first()["summary"]


def test_missing_dumps_and_malformed_records_are_errors(spark, tmp_path):
    _dump(tmp_path, "en", "page", ["(1,0,'One')"])
    run = lambda *a: cli.main(["-d", str(tmp_path / "db"), "-u", "me", "-i", str(tmp_path), *a], spark)
    with pytest.raises(FileNotFoundError, match="en: categorylinks, en: langlinks, en: redirect"):
        run("-r", "import")
    for t in ("redirect", "langlinks", "categorylinks"):
        _dump(tmp_path, "en", t, ["(1,'a'b)"])
    with pytest.raises(Exception, match="malformed record"):
        run("-r", "import")


def test_database_address(spark):
    made = lambda *a: cli.Session(spark, cli.parse(["-u", "me", "-r", "stats", *a])).url()
    assert made("-d", "wiki", "-H", "host", "-P", "5433") == "jdbc:postgresql://host:5433/wiki"
    assert made("-d", "jdbc:x:y") == "jdbc:x:y" and made("-d", "/folder") is None


def test_legacy_tables(spark, tmp_path):
    spark.createDataFrame([("k", False, 2)], "key string, coherent boolean, size int").write.parquet(f"{tmp_path}/old_comp")
    spark.createDataFrame([("en:1", "en", "A", "k")], "key string, lang string, title string, comp_id string").write.parquet(f"{tmp_path}/old_node")
    spark.createDataFrame([("en:1", "de:1", "k")], "src_id string, dst_id string, comp_id string").write.parquet(f"{tmp_path}/old_link")
    comp, node, link = store.read_legacy(spark, str(tmp_path), "old_")
    assert comp.first()["namespace"] == 0 and node.first()["redirect_id"] is None and link.count() == 1
