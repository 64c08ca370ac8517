"""Quality rules: exact counts on every text, and a hashed n-gram likelihood ratio of trusted texts against the corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Sieve, packed, ship, text_or_empty, unpacked

BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WORD_BITS = 21  # three word numbers fit into one 63-bit number
KNOWN_WORDS = 1 << 20  # a task forgets its words beyond this many; nothing counted depends on it
MOST_BITS = 24  # texts are counted in so many buckets, four bytes each in a task; the model has as many or fewer
LOAD = 8  # different grams of the corpus in a bucket of the model, on average
PIECES = 64  # counters travel in so many parts
PRIOR = 4  # weight of the corpus in the trusted multinomial, in counts a bucket: a few trusted texts prove little
MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Words(dict):
    """Numbers the words of one task as they come, and keeps a 32-bit hash of each."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[number] = zlib.crc32(word)
        self[word] = number
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; starts anew between texts when there are too many to keep."""
        if len(self) + len(words) > KNOWN_WORDS and self:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in a window of three words that the text holds at least twice."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) >> WORD_BITS:
        ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        pairs = np.unique(ids[:-1] * len(ids) + ids[1:], return_inverse=True)[1].astype(np.int64)
        keys = pairs[:-1] * len(ids) + ids[2:]
    else:
        keys = (ids[:-2] << (2 * WORD_BITS)) | (ids[1:-1] << WORD_BITS) | ids[2:]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(keys, twice)
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(keys) + shift] |= hit
    return int(covered.sum())


def text_counts(body: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """Number of words, code points in words, symbols, lines equal to an earlier one, words in repeated windows."""
    inside = body.translate(None, BLANK)
    code_points = len(inside.decode("utf-8", "surrogatepass"))
    lines = [line for line in body.split(b"\n") if line.strip()]
    return (
        len(words), code_points, len(inside) - len(inside.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(ids),
    )


def grams(ids: np.ndarray, words: Words, bits: int) -> np.ndarray:
    """Buckets of the text's words and word pairs."""
    h = words.hashes[ids]
    pairs = (h[:-1] * MIX + h[1:]) * MIX
    return np.concatenate([h * MIX, pairs]) >> np.uint64(64 - bits)


def _count(bits: int):
    """Counters of a task, in pieces that hold only what is not zero, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, totals = Words(), None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = grams(words.of(text.encode("utf-8", "surrogatepass").split()), words, bits)
                if totals is None and len(found):
                    totals = np.zeros(1 << bits, np.uint32)
                if len(found):
                    np.add.at(totals, found.astype(np.int64), 1)
        if totals is not None:
            for piece, part in enumerate(np.split(totals, PIECES)):
                at = np.flatnonzero(part)
                if len(at):
                    steps, counts = packed(np.diff(at, prepend=0)), packed(part[at], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([steps]), pa.array([counts])], PIECE_NAMES)

    return run


PIECE_NAMES = ["piece", "steps", "counts"]
PIECE = "piece int, steps binary, counts binary"


def _add_up(bits: int):
    """The sums of the pieces that come to a task, which holds all of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                piece, steps, counts = (batch.column(c)[i].as_py() for c in PIECE_NAMES)
                if piece not in sums:
                    sums[piece] = np.zeros((1 << bits) // PIECES, np.int64)
                sums[piece][np.cumsum(unpacked(steps))] += unpacked(counts, np.int64)
        for piece, part in sums.items():
            at = np.flatnonzero(part)
            row = [[piece], [packed(np.diff(at, prepend=0))], [packed(part[at], np.int64)]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *map(pa.array, row[1:])], PIECE_NAMES)

    return run


def bucket_counts(texts: DataFrame, bits: int) -> np.ndarray:
    """How many grams of all rows of the one text column fall into each of ``2**bits`` buckets."""
    pieces = texts.mapInArrow(_count(bits), PIECE).repartition(PIECES, "piece").mapInArrow(_add_up(bits), PIECE).toArrow()
    totals = np.zeros((PIECES, (1 << bits) // PIECES), np.int64)
    for row in pieces.to_batches():
        for i in range(row.num_rows):
            piece, steps, counts = (row.column(c)[i].as_py() for c in PIECE_NAMES)
            totals[piece][np.cumsum(unpacked(steps))] = unpacked(counts, np.int64)
    return totals.reshape(-1)


def fitting_bits(counts: np.ndarray) -> int:
    """Bits of a hash space in which ``LOAD`` of the different grams counted share a bucket.

    How many different ones there are follows from the share of empty buckets (linear counting).
    """
    empty = max(1, int((counts == 0).sum()))
    different = -len(counts) * np.log(empty / len(counts))
    return int(np.clip(round(np.log2(max(different, 1) / LOAD)), 6, np.log2(len(counts))))


def folded(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts in fewer buckets: a bucket's number is the beginning of the hash."""
    return counts.reshape(1 << bits, -1).sum(axis=1)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = f"doc_id long, {COUNTS}, log_ratio double, base_failed boolean, kept boolean"


def judged(text: str | None, words: Words, ratio: np.ndarray, bits: int, lowest: float) -> tuple:
    """The counts, the mean log ratio, whether the base rules fail, whether the text is kept."""
    body = (text or "").encode("utf-8", "surrogatepass")
    parts = body.split()
    ids = words.of(parts)
    found = grams(ids, words, bits)
    score = float(ratio[found].mean()) if len(found) else 0.0
    counts = text_counts(body, parts, ids)
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    return (*counts, score, failed, not failed and score >= lowest)


def _judge(ratios, bits: int, lowest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = [judged(t, words, ratios.value, bits, lowest) for t in batch.column("text").to_pylist()]
            names = (*COLUMNS, "log_ratio", "base_failed", "kept")
            columns = zip(*rows) if rows else [[] for _ in names]
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    return run


def log_ratios(raw: DataFrame, trusted: DataFrame, bits: int | None = None) -> np.ndarray:
    """Smoothed log-likelihood ratio of each bucket, ``2**bits`` of them; without ``bits``, as many as fit the corpus.

    What a bucket says depends on how many different grams share it: with many their ratios even out, with few the prior
    outweighs them. The number of buckets therefore grows with the number of different grams.
    """
    counts = bucket_counts(raw, bits or MOST_BITS)
    bits = bits or fitting_bits(counts)
    corpus = folded(counts, bits) + 1.0
    del counts
    good = bucket_counts(trusted, bits)
    if not good.any():
        return np.zeros(1 << bits, np.float32)
    corpus /= corpus.sum()
    prior = PRIOR * (1 << bits)
    mixed = (good + prior * corpus) / (good.sum() + prior)
    return (np.log(mixed) - np.log(corpus)).astype(np.float32)


def quality_rules(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None,
    lowest: float = -0.12,
) -> DataFrame:
    """``doc_id``, the counts, ``log_ratio, base_failed, kept``: one row for each row of ``docs``.

    Words and word pairs of every whole text are hashed into ``2**bits`` buckets (unless set, so many that about ``LOAD``
    different grams share one, up to ``2**MOST_BITS``); the trusted texts (column ``text`` of
    ``trusted``) and the whole corpus each give a multinomial over the buckets. A text's ``log_ratio`` is the mean over
    its grams of ln p(trusted) - ln p(corpus). Texts that read like a part of the corpus that the trusted texts lack
    fall below zero; a text is kept if the base rules pass and the ratio is at least ``lowest``, the same threshold for
    every text and every run.

    Null and empty texts have no words and fail the base rules; repeated rows are judged alike; without any trusted
    text all ratios are 0 and the base rules decide; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    body = text_or_empty(text).alias("text")
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs.select(body), trusted.select(text_or_empty().alias("text")), bits))
    bits = int(np.log2(len(ratios.value)))
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), body).mapInArrow(
        _judge(ratios, bits, lowest), RESULT
    )


def keep_good(
    docs: DataFrame, trusted: DataFrame, text: str = "text", bits: int | None = None, lowest: float = -0.12
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns as they are; no row moves.

    Null and empty texts go with the base rules; repeated rows share a verdict; an empty table gives no rows. No column
    is added, so no name can clash.
    """
    spark = docs.sparkSession
    ship(spark)
    body = text_or_empty(text).alias("text")
    ratios = spark.sparkContext.broadcast(log_ratios(docs.select(body), trusted.select(text_or_empty().alias("text")), bits))
    bits = int(np.log2(len(ratios.value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            kept = [judged(t, words, ratios.value, bits, lowest)[-1] for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of ``docs`` that ``labels`` calls good (quality 1)."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return Sieve(good).sift(rows, "doc_id").join(good.hint("shuffle_hash"), "doc_id", "left_semi").select("text")
