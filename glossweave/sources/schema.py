"""The tables of the link graph. Pages refer to themselves by redirect_id; links are multisets."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _table(text: str) -> T.StructType:
    """From ``name type [not null]``, without a session."""
    fields = (f.split() for f in text.split(", "))
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], len(f) == 2) for f in fields])


PAGES = _table("key string not null, lang string not null, namespace int not null, title string not null, redirect_id string, comp_id string")
COMPONENTS = _table("key string not null, namespace int not null, coherent boolean, size int")
LANGLINKS = _table("src_id string not null, dst_id string not null, comp_id string")
PAGELINKS = _table("src_id string not null, dst_id string not null")
CATEGORYLINKS = _table("page_id string not null, category_id string not null")
PATHS = _table("src_id string, dst_id string, length int, serialized string, comp_id string")
POSITIONS = _table("page_id string not null, x double, y double, z double, comp_id string not null")
MEANINGS = _table("auth string not null, page_id string not null, meaning string not null, comp_id string not null")

ALL = {"pages": PAGES, "components": COMPONENTS, "langlinks": LANGLINKS, "pagelinks": PAGELINKS, "categorylinks": CATEGORYLINKS, "paths": PATHS, "positions": POSITIONS, "meanings": MEANINGS}

#: Namespaces that are kept: articles and categories.
ARTICLE, CATEGORY = 0, 14
