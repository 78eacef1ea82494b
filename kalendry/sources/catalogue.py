"""Event catalogues as text files of `- key: value` entries, and back.

Spark splits files between entries, so one file is read by many tasks; kalendry.sources.blocks parses an entry. A file
holding anything before its first entry other than comments fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendry.functions.text import or_default
from kalendry.sources import blocks

KEYS = ("title", "year", "id", "full_name", "link", "deadline", "abstract_deadline", "timezone", "place", "date", "start", "end", "paperslink", "pwclink", "hindex", "sub", "type", "deadline_status", "note", "sync_pin")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every entry of the files, in this order of files: KEYS as strings (sub, sync_pin as arrays), raw (all that the
    entry holds, as a map of text) and ord, which sorts rows as they stand in the files. A missing file fails the read.
    """
    rows = blocks.parsed(blocks.entries(spark, paths), typed=False)
    of = lambda key, kind="string": F.try_variant_get("entry", f"$.{key}", kind)
    several = lambda key: F.coalesce(of(key, "array<string>"), F.when(of(key).isNotNull(), F.array(of(key))))
    known = [F.filter(several(k), lambda x: x.isNotNull() & (x != "")).alias(k) if k in ("sub", "sync_pin") else F.nullif(of(k), F.lit("")).alias(k) for k in KEYS]
    return rows.select("ord", F.variant_get("entry", "$", "map<string,string>").alias("raw"), *known)


def with_defaults(rows: DataFrame) -> DataFrame:
    """What readers may rely on. Empty and missing alike: the title as full name, TBA, h-index 0, General; else null."""
    out = rows.withColumns({c: F.nullif(c, F.lit("")) for c in ("link", "deadline", "abstract_deadline", "start", "end", "paperslink", "pwclink")})
    sub = F.when(F.coalesce(F.size("sub"), F.lit(0)) > 0, F.col("sub")).otherwise(F.array(F.lit("General")))
    usual = {c: or_default(F.col(c), d) for c, d in (("place", "TBA"), ("date", "TBA"), ("note", ""))}
    return out.withColumns(usual | {"full_name": F.coalesce(F.nullif("full_name", F.lit("")), F.col("title")), "year": F.col("year").try_cast("int"), "hindex": F.coalesce(F.col("hindex").try_cast("double"), F.lit(0.0)), "sub": sub})


def _written(c: Column) -> Column:
    """Plain where a reader would see the same text, else quoted: dates, numbers, marks, padded or empty text."""
    risky = c.rlike(r"""^$|^\s|\s$|^[-?:,\[\]{}#&*!|>'"%@`~]|: |:$| #|^\d{4}-\d{2}-\d{2}$|^[0-9.+-]+$|(?i)^(true|false|yes|no|on|off|null)$""")
    return F.when(risky, F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(c)


def entry_text() -> Column:
    """A row of read() as its entry, absent keys left out, keys in the order of KEYS, an empty line after it."""
    lines = []
    for k in KEYS:
        if k in ("sub", "sync_pin"):
            items = F.concat_ws("", F.transform(k, lambda x: F.concat(F.lit("\n    - "), _written(x))))
            lines.append(F.when(F.size(k) > 0, F.concat(F.lit(f"{k}:"), items)))
        elif k in ("year", "hindex"):
            lines.append(F.concat(F.lit(f"{k}: "), F.col(k).cast("string")))
        else:
            lines.append(F.concat(F.lit(f"{k}: "), _written(F.col(k))))
    return F.concat(F.lit("- "), F.concat_ws("\n  ", *lines), F.lit("\n"))


def write(rows: DataFrame, folder: str) -> None:
    """Entries in the order of ord as text files; reading them back gives the same rows."""
    rows.orderBy("ord").select(entry_text().alias("line")).write.mode("overwrite").text(folder)
