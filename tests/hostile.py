"""Hostile variants of a table: empty, nulls in every column, repeated rows, extra columns with clashing names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: names that operators use inside
CLASHING = (
    "node", "parent", "component", "number", "container", "region", "token", "weight", "group_id", "copies", "field", "value", "block", "word", "ids", "u", "n_tokens", "copy_no", "order_key", "residue", "coverage", "joined", "closed", "glyphs", "furniture",
    "markup_nodes", "kind", "start_pos", "end_pos", "ref_key", "ref_at", "alive_from", "alive_until", "src_table", "src_key", "row_no", "units", "prose", "depth", "path", "in_loop", "used_tokens", "reached_share", "n", "count", "x", "key", "rank", "score", "bare", "hid", "line_no",
)


def empty(df: DataFrame) -> DataFrame:
    return df.limit(0)


def with_nulls(df: DataFrame) -> DataFrame:
    """The table, and for each column a copy of some rows with that column null, and a row of nulls only."""
    out = df
    some = df.limit(3)
    for f in df.schema.fields:
        out = out.unionByName(some.withColumn(f.name, F.lit(None).cast(f.dataType)))
    nothing = df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return out.unionByName(nothing)


def repeated(df: DataFrame) -> DataFrame:
    return df.unionByName(df)


def clashing(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})
