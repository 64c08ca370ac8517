"""Helpers of the corpus operators: tables, Python workers, unsigned checksums, tokenizers."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="newsloom-py-"), "newsloom_tasks.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: whatever else a table holds cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def public_vocabulary(name: str) -> str:
    """Where the public tokenizer files lie on this machine (driver or executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def byte_bpe(name: str = "byte_bpe_50k.tiktoken"):
    """An encoder of a public byte-level vocabulary given as ranks; control strings in a text are ordinary text.

    ``byte_bpe_50k.tiktoken`` holds the vocabulary of ``byte_bpe_50k.json`` and gives the same ids several times faster
    (``tests/llm`` compares the two).
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_vocabulary(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


SLICE = 1 << 22  # bytes of a text that are taken apart at a time
BLANK = re.compile(rb"[\x09-\x0D\x20]")


def word_slices(data: bytes, overlap: int, size: int = SLICE) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text (split at ASCII white space) in runs, so that a very long text is never held as words.

    Each run starts with the last ``overlap`` words of what came before; their number is the second value.
    """
    at, carried = 0, []
    while at < len(data):
        end = len(data)
        if at + size < end and (blank := BLANK.search(data, at + size)):
            end = blank.start()
        words = carried + data[at:end].split()
        yield words, len(carried)
        carried = words[max(0, len(words) - overlap) :]
        at = end


def packed(values: np.ndarray, kind: type = np.int32) -> bytes:
    """Mostly small integers compressed, byte by byte of their size."""
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T)
    return zlib.compress(planes.tobytes(), 1)


def unpacked(data: bytes, kind: type = np.int32) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


U = np.uint64


def mixed(z: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of splitmix64)."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


class Sieve:
    """A bitmap of hashed ids: 2**bits bits whatever the number of ids, so it can be broadcast.

    It lets every row of a given id pass and few others, while there are fewer ids than bits; beyond that it lets more
    pass. What passes is joined afterwards, so a sieve only saves moving rows that the join would drop.
    """

    def __init__(self, ids: DataFrame, bits: int = 26) -> None:
        """``ids`` has one column of longs."""
        self.bits = bits
        spark = ids.sparkSession
        ship(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = self.slots(batch.column(0))
                masks = (U(1) << (at & U(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at >> U(6)).astype(np.int32)), pa.array(masks)], ["word", "mask"]
                )

        found = ids.mapInArrow(run, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(1 << (bits - 6), np.int64)
        words[found["word"].to_numpy()] = found["mask"].to_numpy()
        self.words = spark.sparkContext.broadcast(words.view(U))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("bits", "words")}

    def slots(self, ids: pa.Array) -> np.ndarray:
        return mixed(ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(U)) >> U(64 - self.bits)

    def sift(self, df: DataFrame, key: str, passing: bool = True) -> DataFrame:
        """The rows of ``df`` that the sieve lets pass, or those that it holds back, rows with a null key among them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = self.words.value
            for batch in batches:
                ids = batch.column(key)
                known = np.array(ids.is_valid())
                at = self.slots(ids)
                known[known] = (words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
                yield batch.filter(pa.array(known == passing))

        return df.mapInArrow(run, df.schema)
