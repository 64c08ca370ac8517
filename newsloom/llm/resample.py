"""Importance resampling towards a target distribution: hashed n-gram weights, Gumbel scores, distributed quickselect."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Sieve, fresh, ship, text_or_empty, word_slices
from newsloom.operators.ranking import with_position
from newsloom.session import stage

# Letters and digits make words, and so does every byte beyond ASCII; all others count as blanks. Letters are small by then.
TO_BLANKS = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
PIVOTS = 16


def features(text: str, longest: int = 3) -> Iterator[tuple[np.ndarray, int]]:
    """The checksums of all runs of one to ``longest`` words, and how many words are new, slice by slice.

    A run's checksum goes on from that of the run without its last word, so no run is put together as a string.
    """
    data = text.encode("utf-8", "surrogatepass").lower().translate(TO_BLANKS)
    for words, carried in word_slices(data, longest - 1):
        sums = list(map(zlib.crc32, words))
        found, after = [sums[carried:]], [b" " + w for w in words]
        for n in range(2, longest + 1):
            sums = list(map(zlib.crc32, after[n - 1 :], sums))
            found.append(sums[max(0, carried - n + 1) :])  # runs inside the words carried over were there before
        yield np.array([s for part in found for s in part], np.int64), len(words) - carried


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 3, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks send one number for each bucket."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for found, _ in features(t, longest):
                    total += np.bincount(found % buckets, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(total[filled])], ["bucket", "n"])

    sums = (
        texts.select(text_or_empty(text).alias("text")).mapInArrow(run, "bucket int, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed multinomials, rounded down, for each bucket."""
    n = len(raw)
    up = (target + 1).astype(float) * float(raw.sum() + n)
    down = (raw + 1).astype(float) * float(target.sum() + n)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for every row."""
    ship(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for i, t in enumerate(batch.column("text").to_pylist()):
                for found, words in features(t, longest):
                    rows[i] += words, len(found), gain[found % len(gain)].sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, rows.T.copy())], ["doc_id", "n_words", "n_features", "weight"]
            )

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(key: str, seed: int) -> Column:
    """A row's own Gumbel number in thousandths, rounded down; adding it to a weight draws without replacement."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


class Place(NamedTuple):
    """The k-th key, how many rows come before it, and how many have it."""

    key: tuple
    before: int
    equal: int


def quickselect(rows: DataFrame, key: list[str], k: int, seed: int = 42, pivots: int = PIVOTS) -> Place:
    """The ``k``-th smallest composite key (from 1) of a table of at least ``k`` rows, found without a sort.

    ``key`` names columns without nulls. In each round some keys of the rows still in question, picked by a hash that
    changes with the round, are pivots; one pass counts the rows before each and with each, exactly; the k-th key is one of the
    pivots, or lies between two of them, and only rows between these two remain in question.
    """
    whole = F.struct(*key)
    low = high = None
    below, turn = 0, 0  # rows that come before all those in question
    while True:
        left = rows
        if low is not None:
            left = left.filter((F.col(key[0]) >= low[0]) & (whole > _literal(rows, key, low)))
        if high is not None:
            left = left.filter((F.col(key[0]) <= high[0]) & (whole < _literal(rows, key, high)))
        picked = left.select(*key).orderBy(F.xxhash64(*key, F.lit(seed + turn)), *key).limit(pivots).collect()
        points = sorted({tuple(r) for r in picked})
        counted = []
        for i, point in enumerate(points):
            at = _literal(rows, key, point)
            counted += [F.count_if(whole < at).alias(f"before{i}"), F.count_if(whole == at).alias(f"equal{i}")]
        found = left.agg(*counted).first()
        start = below
        for i, point in enumerate(points):
            before, equal = start + found[f"before{i}"], found[f"equal{i}"]
            if before >= k:
                high = point
                break
            if before + equal >= k:
                return Place(point, before, equal)
            low, below = point, before + equal
        turn += 1


def _literal(rows: DataFrame, key: list[str], point: tuple) -> Column:
    kinds = dict(rows.dtypes)
    return F.struct(*[F.lit(v).cast(kinds[name]).alias(name) for name, v in zip(key, point)])


def importance_resample(
    docs: DataFrame, target: DataFrame, parts: int = 5, of: int = 100, least_words: int = 20, buckets: int = 10_000,
    longest: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: one row for each row of ``docs``.

    Words are runs of letters, digits and characters beyond ASCII, ASCII letters lower-cased; features are all runs of one
    to ``longest`` words, repeats included, hashed into ``buckets`` by crc32. A bucket's gain is the log ratio between the
    target's smoothed multinomial and that of all of ``docs``, in thousandths rounded down; ``weight`` sums a row's gains,
    ``score`` adds the row's own Gumbel number, so the best scores are a draw by importance without replacement. Of the N
    rows with ``least_words`` or more, ``floor(parts * N / of)`` are drawn and ranked from 1, ties to smaller ids; ``rank`` is
    null for the others.

    One pass counts all texts, one weighs them with the table of gains (its size is that of the buckets), and
    ``quickselect`` finds the last winner's key, so that only winners are sorted.

    Null texts have no features and weight 0. Rows without an id share one Gumbel number and come last among ties. Rows
    that are equal in id, weight and number of features cannot be told apart; as many of them as needed are drawn. An
    empty target gives gains from ``docs`` alone; an empty ``docs`` gives no rows.
    """
    gain = gains(bucket_counts(docs, buckets, longest, text), bucket_counts(target, buckets, longest, target_text))
    scored = stage(
        weighted(docs, gain, longest, key, text)
        .withColumn("score", F.col("weight") + gumbel("doc_id", seed))
        .withColumn("_down", -F.col("score"))
        .withColumn("_nameless", F.col("doc_id").isNull().cast("int"))
        .withColumn("_id", F.coalesce("doc_id", F.lit(0)))
        .withColumn("_may", F.col("n_words") >= least_words),
        "scored",
    )
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    order = ["_down", "_nameless", "_id", "n_features", "n_words"]
    may = scored.filter("_may")
    k = may.count() * parts // of
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*names, unranked)

    last = quickselect(may, order, k, seed)
    whole, at = F.struct(*order), _literal(scored, order, last.key)
    drawn = may.filter((F.col("_down") <= last.key[0]) & (whole < at)).select(*names, *order)
    others = scored.filter(~F.col("_may") | (whole > at)).select(*names)
    # Rows with the last key are all alike: so many of them are drawn, and so many are not.
    alike = dict(zip(order, last.key))
    row = [
        F.lit(None if alike["_nameless"] else alike["_id"]).cast("long").alias("doc_id"),
        F.lit(alike["n_words"]).cast("long").alias("n_words"), F.lit(alike["n_features"]).cast("long").alias("n_features"),
        (F.lit(-alike["_down"]).cast("long") - gumbel("doc_id", seed)).alias("weight"),
        F.lit(-alike["_down"]).cast("long").alias("score"),
    ]
    spark = docs.sparkSession

    def copies(n: int) -> DataFrame:
        named = spark.range(n).select(row[0])
        return named.select("doc_id", *row[1:])

    tied = copies(k - last.before).select(*names, *[F.lit(alike[c]).cast(dict(scored.dtypes)[c]).alias(c) for c in order if c not in names])
    drawn = drawn.select(*names, *[c for c in order if c not in names]).unionByName(tied)
    winners = stage(drawn.withColumn("_spread", F.monotonically_increasing_id()), "drawn")
    ranked = with_position(winners, [F.col(c).asc() for c in [*order, "_spread"]], "_pos").select(
        *names, (F.col("_pos") + 1).alias("rank")
    )
    rest = others.unionByName(copies(last.before + last.equal - k)).select(*names, unranked)
    return ranked.unionByName(rest)


def drawn_rows(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``importance_resample`` draws, all columns as they are, and ``draw`` with rank, score, weight.

    Ids tell rows apart here: rows that share an id are all returned if one of them is drawn, with the best rank; rows
    without an id are left out. Only drawn rows move. ``draw`` gets another name if there is such a column.
    """
    found = importance_resample(docs, target, key=key, text=text, **options).filter("rank IS NOT NULL")
    own, name = fresh(docs, "_id"), fresh(docs, "draw")
    best = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).agg(
        F.min(F.struct("rank", "score", "weight")).alias(name)
    )
    winners = stage(best, "winners")
    rows = Sieve(winners.select(own)).sift(docs, key)
    return rows.join(winners, F.col(f"`{key}`") == F.col(own)).select(*[F.col(f"`{c}`") for c in docs.columns], name)
