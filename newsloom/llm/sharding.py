"""Proportional stratified interleaving: shards that each hold the mixture of the whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import text_or_empty
from newsloom.session import stage

HASH_BITS = 60  # fifteen hexadecimal digits of a digest


def seeded_hash(seed: int, *parts) -> F.Column:
    """A uniform number below 2**60 for the seed and the row's values."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def interleave(
    docs: DataFrame, shards: int = 24, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text",
    rows_per_bucket: int = 50_000,
) -> DataFrame:
    """``doc_id, source, size, text_crc32, fraction, shard, slot``: one row for each row of ``docs``.

    The rows of a source are ranked by a seeded hash; rank ``r`` of ``n`` stands at the fraction ``(r - 1/2) / n``. In
    the order of fractions every stretch holds each source in proportion, so cutting it into ``shards`` even parts gives
    shards that match the mixture to within one row a source, and differ by one row at most.

    Ranks and positions are counted without bringing a source, or the table, to one task: a hash is uniform, so its
    leading bits cut a source of any size into buckets of about ``rows_per_bucket`` rows in the right order; a row's
    rank is the count of the buckets before plus its place in its own. Fractions are cut up in the same way.

    A null source is a source of its own; a null text has size 8 and checksum 0; rows without a key are placed by their
    text. Rows equal in all of this are interchangeable. An empty table gives no rows.
    """
    body = text_or_empty(text)
    rows = stage(
        docs.select(
            F.col(f"`{key}`").alias("doc_id"),
            F.col(f"`{source}`").cast("string").alias("source"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            seeded_hash(seed, F.col(f"`{key}`").cast("string"), F.md5(body.cast("binary"))).alias("_h"),
        ).withColumn("_stratum", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))),
        "shards",
    )
    total = rows.count()
    bits = max(0, math.ceil(math.log2(max(total, 1) / rows_per_bucket)))
    ties = ["_h", "doc_id", "size", "text_crc32"]

    rows = rows.withColumn("_bucket", F.shiftright("_h", HASH_BITS - bits))
    before = Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_stratum", "_bucket").count()
        .withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .withColumn("_of", F.sum("count").over(Window.partitionBy("_stratum")))
        .drop("count")
    )
    place = F.row_number().over(Window.partitionBy("_stratum", "_bucket").orderBy(*ties))
    ranked = (
        rows.withColumn("_place", place)
        .join(starts, ["_stratum", "_bucket"])
        .withColumn("fraction", (F.col("_start") + F.col("_place") - F.lit(0.5)) / F.col("_of"))
        .withColumn("_band", F.floor(F.col("fraction") * (1 << bits)))
        .drop("_bucket", "_place", "_start", "_of")
    )
    ranked = stage(ranked, "fractions")

    bands = ranked.groupBy("_band").count()
    # One row for each band of some rows_per_bucket rows.
    bands = bands.withColumn(
        "_start",
        F.coalesce(F.sum("count").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("count")
    place = F.row_number().over(Window.partitionBy("_band").orderBy("fraction", "_stratum", *ties))
    position = F.col("_start") + F.col("_place") - 1
    return (
        ranked.withColumn("_place", place)
        .join(bands, "_band")
        .withColumn("_position", position.cast("long"))
        .withColumn("shard", F.expr(f"int(_position * {shards}L div {max(total, 1)}L)"))
        .withColumn("slot", F.expr(f"_position - (shard * {total}L + {shards - 1}L) div {shards}L"))
        .select("doc_id", "source", "size", "text_crc32", "fraction", "shard", F.col("slot").cast("long"))
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed rows (with any columns joined to them) as one folder for each shard, in slot order."""
    (
        placed.repartition("shard").sortWithinPartitions("shard", "slot")
        .write.mode("overwrite").partitionBy("shard").parquet(path)
    )
