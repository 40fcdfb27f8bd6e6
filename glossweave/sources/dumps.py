"""Table dumps: per-language files of INSERT statements, their splitting, finding and tokenizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of the fields that each table's readers use.
FIELDS = {"page": ("page_id", "namespace", "title"), "redirect": ("from_id", "namespace", "title"), "langlinks": ("from_id", "to_lang", "title"), "pagelinks": ("from_id", "namespace", "title"), "categorylinks": ("from_id", "title")}

# A record is what stands between parentheses; fields are quoted, with backslash escapes, or bare. Possessive, so no line backtracks.
_FIELD = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|(?:[^,)'"][^,)]*+)?+"""
RECORD = rf"\(((?:(?:{_FIELD})(?:,(?:{_FIELD}))*+))\)"
_EACH = rf"(?<=^|,)({_FIELD})(?=,|$)"
_NAME = r"([^/]+)wiki-([0-9]{8})-([a-z]+)\.sql(?:\.gz)?$"
#: Folders that ``write_split`` makes.
_FOLDER = r"/lang=([^/]+)/table=([^/]+)/[^/]+$"
#: The date of files that come from an undivided dump.
UNDATED = "00000000"


def _named(path: Column, file: Column) -> tuple[Column, Column, Column]:
    """(lang, date, table) of a dump file by its name, or by the folders that ``write_split`` makes."""
    folder = path.rlike(_FOLDER)
    pick = lambda k: F.regexp_extract(file, _NAME, k)
    lang = F.translate(F.when(folder, F.regexp_extract(path, _FOLDER, 1)).otherwise(pick(1)), "_", "-")
    return lang, F.when(folder, F.lit(UNDATED)).otherwise(pick(2)), F.when(folder, F.regexp_extract(path, _FOLDER, 2)).otherwise(pick(3))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, lang, date, table) of all lines of dump files under a path or glob; the language's ``_`` become ``-``."""
    df = spark.read.option("recursiveFileLookup", True).text(path)
    name = F.col("_metadata.file_name")
    lang, date, kind = _named(F.col("_metadata.file_path"), name)
    return df.select("value", name.alias("file"), lang.alias("lang"), date.alias("date"), kind.alias("table"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(lang, date, table) of the dump files under a path, by their names alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    lang, date, kind = _named(F.col("path"), F.element_at(F.split("path", "/"), -1))
    return found.select(lang.alias("lang"), date.alias("date"), kind.alias("table")).where("table <> ''")


def require(found: DataFrame, tables: tuple[str, ...]) -> None:
    """Raises if a language that has a page table lacks another of these tables. ``found``: ``files``, one row a file."""
    have: dict[str, set[str]] = {}
    for r in found.select("lang", "table").distinct().collect():
        have.setdefault(r["lang"], set()).add(r["table"])
    lacking = sorted(f"{lang}: {t}" for lang, own in have.items() if "page" in own for t in tables if t not in own)
    if lacking:
        raise FileNotFoundError("no dump file of " + ", ".join(lacking))


def read_whole(spark: SparkSession, path: str, wiki: str) -> DataFrame:
    """(value, file, lang, line_no) of undivided dumps ``{lang}{wiki}.sql``; line_no orders the lines of a file.

    A file may be read in several blocks; a line stands by its block's start and its place there."""
    name = F.col("_metadata.file_name")
    lang = F.translate(F.regexp_extract(name, rf"^([a-z]+(?:_[a-z]+(?:_[a-z]+)?)?){wiki}\.sql", 1), "_", "-")
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", name.alias("file"), lang.alias("lang"), line.alias("line_no")).where("lang <> ''")


def languages(lines: DataFrame) -> DataFrame:
    """(lang): the languages that have a page table, sorted."""
    return lines.where(F.col("table") == "page").select("lang").distinct().orderBy("lang")


def statements(lines: DataFrame, table: str) -> DataFrame:
    """(lang, value) of a table's INSERT lines; of several dates of a language the latest (see ``require`` for missing ones)."""
    own = lines.where((F.col("table") == table) & F.col("value").startswith("INSERT INTO"))
    latest = own.groupBy("lang").agg(F.max("date").alias("date"))
    return own.join(latest, ["lang", "date"]).select("lang", "value")


def unescaped(field: Column) -> Column:
    """A field's value: quotes off, the three escapes undone, then every underscore a space."""
    quoted = field.rlike(r"""^['"]""")
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    plain = F.replace(F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.translate(F.when(quoted, plain).otherwise(field), "_", " ")


def _left_over(text: Column) -> Column:
    """What stands in a line beside its records; an opening parenthesis there begins something that is no record."""
    return F.regexp_replace(text, RECORD, "")


def malformed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that hold something which begins like a record and is none, and as ``rest`` what is left of them without their records."""
    return lines.withColumn("rest", _left_over(F.make_valid_utf8(F.col(value)))).where(F.contains("rest", F.lit("(")))


def records(lines: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """All columns of ``lines`` but ``value``, and ``fields``: one row for each record of a line.

    The scan starts at the first parenthesis. A record with bytes that are not UTF-8 is dropped whole: such lines are
    known from their bytes, and in them records that hold the replacement character go. With ``strict`` a malformed line is
    an error; without, its well-formed records come (``malformed`` has the lines)."""
    rest = [c for c in lines.columns if c != value]
    text = F.make_valid_utf8(F.col(value))
    every = F.regexp_extract_all(text, F.lit(RECORD), F.lit(1))
    if strict:
        left = _left_over(text)
        every = F.when(F.contains(left, F.lit("(")), F.raise_error(F.concat(F.lit("malformed record: "), F.substring(left, 1, 200)))).otherwise(every)
    # chosen before they are exploded: what names the line afterwards has the line copied to each of its records
    whole = F.when(F.is_valid_utf8(F.col(value)), every).otherwise(F.filter(every, lambda r: ~F.contains(r, F.lit("�"))))
    found = lines.select(*rest, F.explode(whole).alias("__record"))
    each = F.transform(F.regexp_extract_all(F.col("__record"), F.lit(_EACH), F.lit(1)), unescaped)
    return found.select(*rest, each.alias("fields"))


def read_table(lines: DataFrame, table: str, strict: bool = True) -> DataFrame:
    """(lang, and the table's fields by name) of all records of a table; malformed lines are an error."""
    names = FIELDS[table]
    return records(statements(lines, table), strict=strict).select("lang", *(F.get("fields", F.lit(k)).alias(n) for k, n in enumerate(names)))


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A source without languages."""
    return spark.createDataFrame([], "lang string, " + ", ".join(f"{n} string" for n in FIELDS[table]))


def split_by_table(lines: DataFrame, order: str = "line_no", file: str = "file") -> DataFrame:
    """(file, lang if there, table, order, value) of INSERT lines of undivided dumps, each with the table whose structure comment came last before it.

    A name with other characters than a-z does not match as a whole, so its lines stay with the table before, as lines
    before any comment stay out. ``order`` numbers the lines of a file. Only a file's few comments are gathered; its lines
    stay where they are read."""
    tag = F.regexp_extract("value", r"^-- Table structure for table `([a-z]+)`", 1)
    tags = lines.select(file, F.col(order).alias("o"), tag.alias("t")).where("t <> ''").groupBy(file).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("tags"))
    own = lines.where(F.col("value").startswith("INSERT INTO")).join(tags, file)
    before = F.filter("tags", lambda x: x["o"] < F.col(order))
    kept = [file, *(c for c in lines.columns if c not in (file, order, "value"))]
    return own.withColumn("table", F.get(before, F.size(before) - 1)["t"]).where(F.col("table").isNotNull()).select(*kept, "table", order, "value")


def write_split(split: DataFrame, out: str, order: str = "line_no") -> None:
    """One folder for each language and table, gzipped text; ``read_lines`` takes them back."""
    split.repartition("lang", "table").sortWithinPartitions("lang", "table", order).select("lang", "table", "value").write.mode("overwrite").partitionBy("lang", "table").option("compression", "gzip").text(out)


def insert_line(table: str, *fields: Column) -> Column:
    """A record as dumps write it: numbers bare, texts quoted and escaped, null as NULL."""
    return F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")"))


def quoted(text: Column) -> Column:
    """A text as a dump's quoted field."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit("'"), escaped, F.lit("'"))
