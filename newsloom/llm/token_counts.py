"""Token counts kept up to date by signed changes: additive totals by source, language and tokenizer version."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import byte_bpe, ship, text_or_empty

GROUP = ("source", "lang", "tokenizer_version")
CHANGE = "seq long, doc_id long, op string, source string, lang string, tokenizer_version string, tokens long"
STATE = "doc_id long, seq long, present boolean, source string, lang string, tokenizer_version string, tokens long"
TOTAL = "source string, lang string, tokenizer_version string, docs long, tokens long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, versions = batch.column("text").to_pylist(), batch.column("tokenizer_version").to_pylist()
        found = [len(byte_bpe(version).encode_ordinary(text)) for text, version in zip(texts, versions)]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], pa.array(np.array(found, np.int64))], [*kept, "tokens"]
        )


def count_tokens(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``text`` replaced by ``tokens``, counted with the vocabulary named ``tokenizer_version``.

    Null texts have no tokens; a column that is called ``tokens`` already is replaced; an empty table gives no rows.
    """
    ship(rows.sparkSession)
    rows = rows.drop("tokens").withColumn("text", text_or_empty())
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(_counts, ", ".join([*fields, "tokens long"]))


class TokenRollup:
    """Totals of documents and tokens in a shared folder, changed by batches of inserts, deletes and revisions.

    A batch is a table of changes (``CHANGE``): ``op`` is ``insert``, ``revise`` or ``delete``, ``seq`` orders the
    changes of a document, and the other columns say what holds afterwards. Each batch writes two tables under its own
    number: the last state of every document it touched, and signed totals, minus what the documents counted before and
    plus what they count now. What counted before is read from earlier batches only, so committing a batch again, after
    a failure or a repeated delivery, writes the same tables in the same place. The list of commits is written last;
    tables of a batch that is not on it are not read.

    An insert of a known document or a revision of an unknown one sets its state; a delete of an unknown one changes
    nothing. Of several changes to a document in a batch the one with the largest ``seq`` holds (ties: a delete last).
    Changes without ``doc_id`` or with another ``op`` change nothing. Null sources and languages are groups of their
    own; null tokens count 0. An empty batch commits no change.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, batches: list[int], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/{b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def batches(self) -> list[int]:
        """Numbers of the committed batches (one number a batch)."""
        try:
            done = self.spark.read.schema("batch long").parquet(f"{self.folder}/commits").distinct().collect()
        except AnalysisException:
            return []
        return sorted(r.batch for r in done)

    def states(self, before: int | None = None) -> DataFrame:
        """The last state of every document, as of the batches below ``before``; deleted ones are not present."""
        known = [b for b in self.batches() if before is None or b < before]
        rows = self._read("states", known, STATE + ", batch long")
        values = F.struct("batch", *[c.split()[0] for c in STATE.split(", ")])
        return rows.groupBy("doc_id").agg(F.max_by(values, "batch").alias("_s")).select("_s.*").drop("batch")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Work out the batch's tables, write them over any earlier attempt, then put the batch on the list."""
        rank = F.struct("seq", (F.col("op") == "delete").alias("_last"), F.col("tokens"))
        kept = [c.split()[0] for c in CHANGE.split(", ")]
        last = (
            changes.filter(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "revise", "delete"))
            .select(*kept).groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in kept if c != "doc_id"]), rank).alias("_c"))
            .select("doc_id", "_c.*")
            .select(
                "doc_id", "seq", (F.col("op") != "delete").alias("present"), *GROUP,
                F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.lit(batch).cast("long").alias("batch"),
            )
        )
        states = f"{self.folder}/states/{batch}"
        last.write.mode("overwrite").parquet(states)
        now = self.spark.read.schema(STATE + ", batch long").parquet(states)
        then = self.states(before=batch).join(now.select("doc_id"), "doc_id", "left_semi")
        signed = then.filter("present").select(*GROUP, F.lit(-1).alias("sign"), "tokens").unionByName(
            now.filter("present").select(*GROUP, F.lit(1).alias("sign"), "tokens")
        )
        delta = signed.groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")
        )
        delta.write.mode("overwrite").parquet(f"{self.folder}/totals/{batch}")
        if batch not in self.batches():
            self.spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(
                f"{self.folder}/commits"
            )

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer_version, docs, tokens``: the sum of all signed totals, groups of no document left out."""
        sums = self._read("totals", self.batches(), TOTAL).groupBy(*GROUP)
        return sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
