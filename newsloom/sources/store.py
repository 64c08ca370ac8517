"""The article store: a Parquet table with the latest row per URL, whole or in buckets that change one by one."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.functions import dates
from newsloom.session import stage
from newsloom.sources.manifest import Manifests

# The stored columns; the first six default to an empty string, the others to null.
STORE_COLUMNS = (
    "url", "title", "date", "content", "summary", "ai_validation", "category", "category_justification",
)
_EMPTY_DEFAULTS = ("content", "summary", "ai_validation")


def evolve_schema(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Add the wanted columns that are missing, as nulls; leave the others alone."""
    missing = {name: F.lit(None).cast(kind) for name, kind in wanted.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def to_store_rows(articles: DataFrame, created_at, seq: str | None = None) -> DataFrame:
    """Articles in store shape, stamped with a time or a column.

    ``seq`` names the column that orders writes of the same moment; the last one wins.
    """
    shaped = evolve_schema(articles, {c: "string" for c in STORE_COLUMNS})
    columns = [
        F.coalesce(F.col(c), F.lit("")).alias(c) if c in _EMPTY_DEFAULTS else F.col(c).alias(c)
        for c in STORE_COLUMNS
    ]
    order = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    return shaped.select(*columns, dates.as_timestamp(created_at).alias("created_at"), order.alias("seq"))


def last_writes(incoming: DataFrame) -> DataFrame:
    """The last write of each URL: the newest ``created_at``, then the highest ``seq``, then title and content decide.

    The rows are written once, each with a number; the winner is settled on the number and the columns that order writes,
    and only then fetched, so no text is sorted or carried through an aggregate. Of equal texts any may stand, so texts
    are compared by a hash.
    """
    numbered = incoming.withColumn("_row", F.monotonically_increasing_id()).withColumn("_text", F.xxhash64("content"))
    rows = stage(numbered, "incoming")
    order = F.struct(
        (-F.unix_micros("created_at")).alias("age"), (-F.coalesce(F.col("seq"), F.lit(0))).alias("turn"),
        "title", "_text", "_row",
    )
    winners = rows.groupBy("url").agg(F.min(order).alias("_won")).select(F.col("_won._row").alias("_row"))
    return rows.join(winners, "_row", "left_semi").drop("_row", "_text")


def upsert_store(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Whole-row replacement by ``url``: the last incoming write of a URL (``last_writes``) replaces the stored row.

    The store holds one row per URL already, so it only loses the replaced ones in an anti join: a small batch is
    broadcast and the store is not shuffled. ``BucketedStore`` does the same to a stored table in place.
    """
    latest = last_writes(incoming)
    if existing is None:
        return latest
    latest = stage(latest, "latest")
    kept = existing.join(latest.select("url"), "url", "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


class BucketedStore:
    """An article store in buckets by URL; a batch rewrites only the buckets that its URLs fall into.

    ``data/<version>/_bucket=<b>`` holds a bucket as that version wrote it, and a description of the state
    (``Manifests``) says in which version each bucket is. It is written last: until then readers see the state before, and a
    batch that failed is written over by the next attempt. A version that is there already is not written again, so
    a batch that is delivered twice counts once.

    Choose ``buckets`` so that one holds some hundred MB, since each is rewritten by one task; the number is fixed when
    the store is made. Columns that a batch does not have are null in its rows, new ones are null in the rows before.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifests = Manifests(spark, f"{self.folder}/manifests")
        self.buckets = (self.manifests.last() or {}).get("buckets", buckets)

    def _state(self) -> dict:
        return self.manifests.last() or {"version": -1, "buckets": self.buckets, "at": {}, "schema": None}

    def version(self) -> int:
        """The last version, or -1."""
        return self._state()["version"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict, buckets: Iterable[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.folder}/data/{state['at'][b]}/_bucket={b}" for b in buckets if b in state["at"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows, one for each URL; an empty store has no columns but ``url``."""
        state = self._state()
        if state["schema"] is None:
            return self.spark.createDataFrame([], "url string")
        return self._rows(state, state["at"])

    def upsert(self, incoming: DataFrame, version: int | None = None) -> bool:
        """Put the last write of each incoming URL into the store; False if this version is there already."""
        state = self._state()
        version = state["version"] + 1 if version is None else version
        if version <= state["version"]:
            return False
        latest = stage(last_writes(incoming).withColumn("_bucket", self._bucket()), "latest")
        touched = [str(r["_bucket"]) for r in latest.select("_bucket").distinct().orderBy("_bucket").collect()]
        schema = latest.drop("_bucket").schema
        if touched:
            rows = latest
            if state["schema"] is not None:
                old = self._rows(state, touched).join(latest.select("url"), "url", "left_anti")
                rows = old.withColumn("_bucket", self._bucket()).unionByName(latest, allowMissingColumns=True)
                schema = rows.drop("_bucket").schema
            rows.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(
                f"{self.folder}/data/{version}"
            )
        self.manifests.commit(
            {
                "version": version, "buckets": self.buckets, "schema": json.dumps(schema.jsonValue()),
                "at": state["at"] | {b: version for b in touched},
            }
        )
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete the buckets that none of the last ``keep`` states names; how many were deleted."""
        forgotten = self.manifests.forget(keep)
        named = {(v, b) for n in self.manifests.numbers() for b, v in self.manifests.read(n)["at"].items()}
        gone = {(v, b) for state in forgotten for b, v in state["at"].items()} - named
        for v, b in gone:
            self.manifests.remove(f"{self.folder}/data/{v}/_bucket={b}")
        return len(gone)


def load_store(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Stored articles, newest first."""
    return newest_stored(spark.read.parquet(path), limit)


def newest_stored(store: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = store.orderBy(F.col("created_at").desc(), "url")
    return ordered.limit(limit) if limit else ordered


def save_store(rows: DataFrame, path: str) -> None:
    """Write a new version of the store. Readers of the previous folder are not disturbed."""
    rows.write.mode("errorifexists").parquet(path)
