"""The scan log: what micro-batches found, kept in runs that are merged level by level."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.session import stage
from newsloom.sources.manifest import Manifests


class ScanLog:
    """One row for each key, from batches that are committed exactly once.

    A batch is written as a run of level 0 under its own number, with one row for each key. ``fan`` runs of a level are
    merged into one of the next, so after n batches there are at most ``fan`` times log(n) runs to read, and a row is
    written again log(n) times in all. A description of the state (``Manifests``) names the runs and the last batch; it is written
    last, so a batch that fails leaves nothing that is read, its repetition writes over what it left, and a batch that is
    delivered again after its commit changes nothing.

    Of rows with the same key the one with the smallest ``order`` holds, then that of the earliest batch; with ``newest``
    the latest batch comes before ``order``. Which row holds therefore does not depend on when runs are merged, nor,
    without ``newest`` and with an ``order`` that tells rows apart, on how input is cut into batches. Rows may leave the
    log when ``ts`` falls behind the look-back that a commit names: readers do not see them from then on, and the next
    merge drops them. Rows without a key, or without a time where a look-back is used, are not kept.
    """

    def __init__(
        self, spark: SparkSession, folder: str, key: str = "url", order: Sequence[str] = (), newest: bool = False,
        ts: str | None = None, fan: int = 8,
    ) -> None:
        self.spark, self.folder, self.key, self.order, self.newest = spark, folder.rstrip("/"), key, tuple(order), newest
        self.ts, self.fan = ts, fan
        self.manifests = Manifests(spark, f"{self.folder}/manifests")

    def _state(self) -> dict:
        return self.manifests.last() or {"batch": -1, "runs": [], "schema": None, "since": None}

    def last_batch(self) -> int:
        """The number of the last batch, or -1."""
        return self._state()["batch"]

    def runs(self) -> list[dict]:
        """The runs that are read: their folders, levels, first and last batches."""
        return self._state()["runs"]

    def _place(self) -> Column:
        turn = [(-F.col("seq")).alias("_turn")] if self.newest else []
        return F.struct(*turn, *self.order, F.col("seq").alias("_seq"))

    def _open(self, state: dict, runs: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/runs/{r['name']}" for r in runs])

    def _live(self, rows: DataFrame, since: str | None) -> DataFrame:
        if self.ts is None or since is None:
            return rows
        return rows.where(F.col(self.ts) >= F.lit(since).cast("timestamp"))

    def _merged(self, rows: DataFrame) -> DataFrame:
        """The row that holds for each key. Only keys and places are grouped; rows of keys that several runs have lose
        the others in a join with these keys, which is a broadcast when they are few."""
        places = rows.select(self.key, self._place().alias("_place"))
        several = (
            places.groupBy(F.col(self.key).alias("_key")).agg(F.min("_place").alias("_best"), F.count("*").alias("_n"))
            .where("_n > 1").select("_key", "_best")
        )
        several = stage(several, "several")
        held = rows.withColumn("_place", self._place()).join(several, F.col(self.key) == F.col("_key"), "left")
        return held.where(F.col("_key").isNull() | F.col("_place").eqNullSafe(F.col("_best"))).drop("_place", "_key", "_best")

    def commit(self, batch: int, rows: DataFrame, since: str | None = None) -> bool:
        """Write a batch and put it on the list; False if it is there already. ``since`` moves the look-back on."""
        state = self._state()
        if batch <= state["batch"]:
            return False
        since = max(filter(None, (since, state["since"])), default=None)
        numbered = self._live(rows.where(F.col(self.key).isNotNull()), since).withColumn("seq", F.lit(batch).cast("long"))
        numbered = stage(numbered.withColumn("_row", F.monotonically_increasing_id()), "batch")
        first = numbered.groupBy(self.key).agg(
            F.min(F.struct(*self.order, "_row")).alias("_first")
        ).select(F.col("_first._row").alias("_row"))
        name = f"{batch}-{batch}-0"
        once = numbered.join(first, "_row", "left_semi").drop("_row")
        once.write.mode("overwrite").parquet(f"{self.folder}/runs/{name}")
        schema = once.schema
        if state["schema"] is not None:  # columns that only earlier batches had stay
            before = StructType.fromJson(json.loads(state["schema"]))
            schema = StructType([*schema.fields, *[f for f in before.fields if f.name not in schema.names]])
        runs = [*state["runs"], {"name": name, "level": 0, "first": batch, "last": batch}]
        self.manifests.commit(
            {"batch": batch, "runs": runs, "schema": json.dumps(schema.jsonValue()), "since": since}
        )
        self.merge()
        return True

    def merge(self) -> None:
        """Merge the runs of every level that has ``fan`` of them, lowest level first."""
        while True:
            state = self._state()
            levels = [r["level"] for r in state["runs"]]
            full = min((x for x in set(levels) if levels.count(x) >= self.fan), default=None)
            if full is None:
                return
            old = [r for r in state["runs"] if r["level"] == full]
            run = {"level": full + 1, "first": old[0]["first"], "last": old[-1]["last"]}
            run["name"] = f"{run['first']}-{run['last']}-{run['level']}"
            rows = self._live(self._open(state, old), state["since"])
            self._merged(rows).write.mode("overwrite").parquet(f"{self.folder}/runs/{run['name']}")
            at = state["runs"].index(old[0])
            runs = [r for r in state["runs"] if r["level"] != full]
            self.manifests.commit(state | {"runs": [*runs[:at], run, *runs[at:]]})

    def vacuum(self, keep: int = 2) -> int:
        """Delete the runs that none of the last ``keep`` states names; how many were deleted."""
        forgotten = self.manifests.forget(keep)
        named = {r["name"] for n in self.manifests.numbers() for r in self.manifests.read(n)["runs"]}
        gone = {r["name"] for state in forgotten for r in state["runs"]} - named
        for name in gone:
            self.manifests.remove(f"{self.folder}/runs/{name}")
        return len(gone)

    def read(self, schema: str | None = None) -> DataFrame:
        """The rows that hold, with ``seq``, the batch that they are from. An empty log has the columns of ``schema``."""
        state = self._state()
        if not state["runs"]:
            return self.spark.createDataFrame([], schema or f"{self.key} string, seq long")
        rows = self._live(self._open(state, state["runs"]), state["since"])
        return rows if len(state["runs"]) == 1 else self._merged(rows)
