"""Splitting long texts for batch inference. The fold runs inside the row; rows are exploded afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators.takeaways import sentences

CHARS_PER_TOKEN = 3
_RUN = "struct<first:int,size:int,cut:boolean>"


def chunks_of(content: Column, max_tokens: int) -> Column:
    """Array of chunks: whole sentences packed greedily up to three characters per token.

    Joining spaces do not count. A sentence over the limit closes the open chunk and is cut at the limit. The fold sees
    sentence lengths only and notes where each chunk begins and how many sentences it has; texts are put together once.
    """
    limit = max_tokens * CHARS_PER_TOKEN

    def state(at: Column, chars: Column, held: Column, runs: Column) -> Column:
        return F.struct(
            at.cast("int").alias("at"), chars.cast("int").alias("chars"), held.cast("int").alias("held"), runs.alias("runs")
        )

    def run(first: Column, size: Column, cut: bool) -> Column:
        return F.array(F.struct(first.alias("first"), size.alias("size"), F.lit(cut).alias("cut")).cast(_RUN))

    def closed(acc: Column) -> Column:
        return F.when(acc["held"] == 0, acc["runs"]).otherwise(
            F.concat(acc["runs"], run(acc["at"] - acc["held"], acc["held"], False))
        )

    def add(acc: Column, size: Column) -> Column:
        at = acc["at"] + 1
        return (
            F.when(
                size > limit,
                state(at, F.lit(0), F.lit(0), F.concat(closed(acc), run(acc["at"], F.lit(1), True))),
            )
            .when(acc["chars"] + size > limit, state(at, size, F.lit(1), closed(acc)))
            .otherwise(state(at, acc["chars"] + size, acc["held"] + 1, acc["runs"]))
        )

    def pack(parts: Column) -> Column:
        begin = state(F.lit(0), F.lit(0), F.lit(0), F.array().cast(f"array<{_RUN}>"))
        runs = F.aggregate(F.transform(parts, lambda s: F.length(s)), begin, add, closed)

        def written(r: Column) -> Column:
            whole = F.array(F.array_join(F.slice(parts, r["first"] + 1, r["size"]), " "))
            cuts = text.let(
                F.get(parts, r["first"]),
                lambda s: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(limit)),
                    lambda i: F.substr(s, i, F.lit(limit)),
                ),
            )
            return F.when(r["cut"], cuts).otherwise(whole)

        return F.flatten(F.transform(runs, written))

    packed = text.let(sentences(content), pack)
    return F.when(F.length(content) < limit, F.array(content)).otherwise(packed)


def chunk_articles(df: DataFrame, max_tokens: int = 40000, key: str = "id", column: str = "content") -> DataFrame:
    """``key, chunk_no, chunk, tokens``, the token estimate being a third of the characters."""
    normalized = df.select(key, text.collapse_spaces(F.col(column)).alias("_text"))
    # outer: an inner explode would repeat the fold in a filter on the array's size
    packed = F.posexplode_outer(chunks_of(F.col("_text"), max_tokens))
    rows = normalized.select(key, packed.alias("chunk_no", "chunk")).where(F.col("chunk").isNotNull())
    return rows.withColumn("tokens", F.floor(F.length("chunk") / CHARS_PER_TOKEN).cast("int"))


def truncate_chunks(
    df: DataFrame, max_tokens: int = 1000, key: str = "id", column: str = "content"
) -> DataFrame:
    """The compatibility variant: the same chunks, each cut to 1.2 characters per token (text is lost)."""
    rows = chunk_articles(df, max_tokens, key, column)
    return rows.withColumn("chunk", F.substring("chunk", 1, int(max_tokens * 1.2))).drop("tokens")
