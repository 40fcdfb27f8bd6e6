"""Version-5 UUIDs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name spaces of RFC 9562.
DNS = "6ba7b8109dad11d180b400c04fd430c8"
URL = "6ba7b8119dad11d180b400c04fd430c8"
OID = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(namespace: str, name: Column) -> Column:
    """The UUID of ``name`` in a name space given as 32 hex digits; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def uuid5_sql(namespace: str, name: str) -> str:
    """The same in DuckDB's SQL."""
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )
