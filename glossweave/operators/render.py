"""Components as SVG and XML text, written to sharded paths, and the reading of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.operators.layout import bounding_box
from glossweave.sources.schema import CATEGORY

# Scales of drawings, strokes for a weight of one, styles of their groups, and how far labels stand off.
PAGE_SCALE, SKELETON_SCALE, STROKE = 100.0, 12.0, 0.4
INSIDE, CUT = "stroke: lightgray;", "stroke: red;"
CIRCLES, LABELS = "fill: lightgray; stroke: lightgray; stroke-width: 1;", "stroke: black; stroke-width: 0.1; font-size: 4pt;"
PAGE_RADIUS, PAGE_LABEL, SKELETON_LABEL = 1.0, 1.0, -1.0
AUTH = "analysis.genetic"
XML_HEAD, SVG_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n', '<?xml version="1.0"?>\n'


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _num(x: Column) -> Column:
    return F.format_string("%.6f", x)


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _joined(items: DataFrame, name: str) -> DataFrame:
    """One text a component from (root, o, t), by the sort key o."""
    return items.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda s: s["t"]), "").alias(name))


def _group(style: str, body: Column) -> Column:
    return _text(f'<g style="{style}">\n', F.coalesce(body, F.lit("")), "</g>\n")


def _svg(box: DataFrame, groups: list[tuple[str, DataFrame]], scale: float) -> DataFrame:
    """(root, svg): as large as the box, and in it a group of each style."""
    parts = box
    for k, (_, items) in enumerate(groups):
        parts = parts.join(_joined(items, f"g{k}"), "root", "left")
    w, h = (F.floor((F.col(f"max_{a}") - F.col(f"min_{a}")) * scale).cast("string") for a in "xy")
    return parts.select("root", _text(SVG_HEAD, '<svg height="', h, '" width="', w, '">\n', *(_group(style, F.col(f"g{k}")) for k, (style, _) in enumerate(groups)), "</svg>\n").alias("svg"))


def _line(x1: str, y1: str, x2: str, y2: str, width: Column) -> Column:
    return _text('  <line x1="', _num(F.col(x1)), '" y1="', _num(F.col(y1)), '" x2="', _num(F.col(x2)), '" y2="', _num(F.col(y2)), '" style="stroke-width: ', _num(width), ';"/>\n')


def _circle(radius: Column) -> Column:
    return _text('  <circle cx="', _num(F.col("px")), '" cy="', _num(F.col("py")), '" r="', _num(radius), '"/>\n')


def _label(off: float, name: Column) -> Column:
    return _text('  <text x="', _num(F.col("px") + off), '" y="', _num(F.col("py") + off), '">', escaped(name), "</text>\n")


def _placed(positions: DataFrame, box: DataFrame, scale: float) -> DataFrame:
    """Positions as points of the drawing, which begins at the box's corner."""
    return positions.join(box, "root").withColumns({"px": (F.col("x") - F.col("min_x")) * scale, "py": (F.col("y") - F.col("min_y")) * scale})


def component_svg(pages: DataFrame, edges: DataFrame, positions: DataFrame, meanings: DataFrame) -> DataFrame:
    """(root, svg): edges inside a meaning lightgray, others red, as wide as they weigh; pages that redirect nowhere as circles, labelled with language and title.

    Pages without a position or a meaning are left out, with their edges. All numbers have six decimals; lines, circles and
    labels come in order of page keys."""
    at = positions.select("page_id", "root", "x", "y").join(meanings.select("page_id", "meaning"), "page_id")
    box = bounding_box(at)
    at = _placed(at, box, PAGE_SCALE).select("page_id", "root", "meaning", "px", "py")
    a, b = (at.select(F.col("page_id").alias(k), F.col("root").alias(f"r{k}"), F.col("meaning").alias(f"m{k}"), F.col("px").alias(f"x{k}"), F.col("py").alias(f"y{k}")) for k in "ab")
    e = edges.join(a, "a").join(b, "b").select(F.col("ra").alias("root"), "ma", "mb", F.struct("a", "b").alias("o"), _line("xa", "ya", "xb", "yb", F.col("weight") * STROKE).alias("t"))
    p = at.join(pages.where("redirect_id is null").select(F.col("key").alias("page_id"), "lang", "namespace", "title"), "page_id").withColumnRenamed("page_id", "o")
    name = _text(F.col("lang"), ":", F.when(F.col("namespace") == CATEGORY, "Category:").otherwise(""), F.col("title"))
    circles, labels = p.select("root", "o", _circle(F.lit(PAGE_RADIUS)).alias("t")), p.select("root", "o", _label(PAGE_LABEL, name).alias("t"))
    return _svg(box, [(INSIDE, e.where("ma = mb")), (CUT, e.where("ma <> mb")), (CIRCLES, circles), (LABELS, labels)], PAGE_SCALE)


def skeleton_svg(nodes: DataFrame, links: DataFrame, positions: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """(root, svg) of meanings: circles by the root of their size, red lines by the logarithm of the edges between them.

    With ``inside`` (root, meaning, n: edges inside a meaning) each such meaning has a line to itself, too."""
    box = bounding_box(positions)
    at = _placed(positions.select("root", "meaning", "x", "y"), box, SKELETON_SCALE).select("root", "meaning", "px", "py")
    every = links.select("root", "m1", "m2", "n")
    if inside is not None:
        every = every.unionByName(inside.select("root", F.col("meaning").alias("m1"), F.col("meaning").alias("m2"), "n"))
    a, b = (at.select("root", F.col("meaning").alias(m), F.col("px").alias(f"x{m}"), F.col("py").alias(f"y{m}")) for m in ("m1", "m2"))
    e = every.join(a, ["root", "m1"]).join(b, ["root", "m2"])
    lines = e.select("root", F.struct("m1", "m2").alias("o"), _line("xm1", "ym1", "xm2", "ym2", STROKE * F.log1p("n")).alias("t"))
    p = at.join(nodes, ["root", "meaning"]).withColumnRenamed("meaning", "o")
    circles, labels = p.select("root", "o", _circle(F.sqrt("size")).alias("t")), p.select("root", "o", _label(SKELETON_LABEL, F.col("label")).alias("t"))
    return _svg(box, [(CUT, lines), (CIRCLES, circles), (LABELS, labels)], SKELETON_SCALE)


def svg_names(svgs: DataFrame) -> DataFrame:
    """(root, name): English labels of a drawing, other characters than letters and digits as ``_``, sorted and joined by `` + ``; drawings without any are left out."""
    found = F.array_sort(F.transform(F.regexp_extract_all("svg", F.lit(r">en:([^<]*)<"), F.lit(1)), lambda t: F.regexp_replace(t, "[^a-zA-Z0-9]", "_")))
    return svgs.select("root", F.array_join(found, " + ").alias("name")).where("name <> ''")


def partition_xml(pages: DataFrame, langlinks: DataFrame, edges: DataFrame, meanings: DataFrame, comps: DataFrame, with_common: bool = False) -> DataFrame:
    """(root, xml): clusters by meaning with their pages by key and links inside them, then links between clusters as incoherent.

    ``comps``: root, comp_id, namespace. Links are occurrences and name the pages they were made between; a link is inside a
    cluster if what its end redirects to is. With ``with_common`` each tells the common categories of its edge (n_categories
    in ``edges``), 0 where its end redirects. Redirects are pages of what they lead to. Indented by tabs, attributes by name."""
    of = meanings.select("page_id", "meaning", "root")
    own = of.join(pages.select(F.col("key").alias("page_id"), "lang", "title", "redirect_id"), "page_id")
    redirect = F.when(F.col("redirect_id").isNotNull(), _text(' redirect="', escaped(F.col("redirect_id")), '"')).otherwise("")
    page = own.select("root", "meaning", F.struct(F.lit(0).alias("k"), F.col("page_id").alias("a"), F.lit("").alias("b"), _text('\t\t<page id="', escaped(F.col("page_id")), '" lang="', escaped(F.col("lang")), '"', redirect, ' title="', escaped(F.col("title")), '"/>\n').alias("t")).alias("x"))
    to = pages.where("redirect_id is not null").select(F.col("key").alias("dst_id"), "redirect_id")
    l = langlinks.select("src_id", "dst_id").join(to, "dst_id", "left").withColumn("end", F.coalesce("redirect_id", "dst_id"))
    l = l.join(of.select(F.col("page_id").alias("src_id"), F.col("meaning").alias("m1"), "root"), "src_id").join(of.select(F.col("page_id").alias("end"), F.col("meaning").alias("m2")), "end")
    common = F.lit("")
    if with_common:
        l = l.withColumns({"a": F.least("src_id", "end"), "b": F.greatest("src_id", "end")}).join(edges.select("a", "b", "n_categories"), ["a", "b"], "left")
        common = _text('common="', F.when(F.col("redirect_id").isNotNull(), 0).otherwise(F.coalesce("n_categories", F.lit(0))).cast("string"), '" ')
    text = _text("\t\t<link ", common, 'from="', escaped(F.col("src_id")), '" to="', escaped(F.col("dst_id")), '"/>\n')
    l = l.select("root", "m1", "m2", F.struct(F.lit(1).alias("k"), F.col("src_id").alias("a"), F.col("dst_id").alias("b"), text.alias("t")).alias("x"))
    body = page.union(l.where("m1 = m2").select("root", F.col("m1").alias("meaning"), "x"))
    texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["t"]), "")
    clusters = body.groupBy("root", "meaning").agg(_text('\t<cluster id="', F.col("meaning"), '">\n', texts("x"), "\t</cluster>\n").alias("t"))
    inner = clusters.groupBy("root").agg(texts(F.struct(F.col("meaning").alias("o"), "t")).alias("inner"))
    cut = l.where("m1 <> m2").groupBy("root").agg(texts("x").alias("cut"))
    head = _text(XML_HEAD, '<component id="', F.col("comp_id"), '" namespace="', F.col("namespace").cast("string"), '">\n')
    rest = F.when(F.col("cut").isNull(), "\t<incoherent/>\n").otherwise(_text("\t<incoherent>\n", F.col("cut"), "\t</incoherent>\n"))
    return inner.join(comps, "root").join(cut, "root", "left").select("root", _text(head, F.col("inner"), rest, "</component>\n").alias("xml"))


def write_sharded(texts: DataFrame, out: str, name: str, text: str, suffix: str) -> None:
    """Each text as a file of its own under ``out``/shard1=ab/shard2=cd/file=NAME SUFFIX, by its name's first four characters.

    Spark names the file in that folder; its content is the text. ``read_sharded`` takes them back."""
    df = texts.select(F.substring(name, 1, 2).alias("shard1"), F.substring(name, 3, 2).alias("shard2"), F.concat(name, F.lit(suffix)).alias("file"), F.regexp_replace(text, "\n$", "").alias("text"))
    df.repartition("shard1", "shard2").write.mode("overwrite").partitionBy("shard1", "shard2", "file").text(out)


def read_sharded(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of all files that ``write_sharded`` made under a path."""
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/file=([^/]+)/[^/]+$", 1))
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(name.alias("file"), F.col("value").alias("text"))


def parse_partition(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """(comp_id, namespace, langs, clusters) of partition texts: each cluster's pages (lang, title) that redirect nowhere, and all languages of these.

    If any cluster has two such pages of one language, the partition has no clusters and no languages."""
    page = "struct<_lang:string,_title:string,_redirect:string>"
    parsed = F.from_xml(F.col(xml), f"_id string, _namespace int, cluster array<struct<page:array<{page}>>>")
    p = texts.select(parsed.alias("p"))
    kept = F.transform(F.coalesce("p.cluster", F.array()), lambda c: F.transform(F.filter(F.coalesce(c["page"], F.array()), lambda x: F.coalesce(x["_redirect"], F.lit("")) == ""), lambda x: F.struct(x["_lang"].alias("lang"), x["_title"].alias("title"))))
    twice = F.exists(kept, lambda c: F.size(c) > F.size(F.array_distinct(F.transform(c, lambda x: x["lang"]))))
    clusters = F.when(twice, F.array().cast("array<array<struct<lang:string,title:string>>>")).otherwise(kept)
    return p.select(F.col("p._id").alias("comp_id"), F.col("p._namespace").alias("namespace"), F.array_sort(F.array_distinct(F.transform(F.flatten(clusters), lambda x: x["lang"]))).alias("langs"), clusters.alias("clusters"))


def read_partition_files(spark: SparkSession, path: str) -> DataFrame:
    """Partitions of XML files, one a file, wherever they lie under a path."""
    return parse_partition(read_sharded(spark, path), "text")


def cluster_pages(parsed: DataFrame) -> DataFrame:
    """(comp_id, namespace, cluster_no, lang, title) of parsed partitions."""
    one = parsed.select("comp_id", "namespace", F.posexplode("clusters").alias("cluster_no", "c"))
    return one.select("comp_id", "namespace", "cluster_no", F.explode("c").alias("x")).select("comp_id", "namespace", "cluster_no", "x.lang", "x.title")
