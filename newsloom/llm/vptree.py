"""SimHash near-duplicates: fingerprints dealt out and searched by vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import U, ship, text_or_empty, word_slices
from newsloom.llm.components import components
from newsloom.session import stage

BITS = 64
CANDIDATES = 8  # vantage points tried at a split
TRIED_ON = 2048  # fingerprints that they are tried on
FEW = 256  # so many fingerprints are compared with each other directly
WORTH = 0.8  # a split has to save this share of the comparisons, or it is not made
SAMPLE = 64  # sampled fingerprints for each leaf of the shared tree
MOST_LEAVES = 16_384  # the shared tree holds no more, so that it and its sample (8 MB) stay small


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64 bits: each is set if it is set in over half of the hashes of the text's shingles, repeats included."""
    data = text.encode("utf-8", "surrogatepass").lower()  # ASCII letters only
    counts, n, seen = np.zeros(BITS, np.int64), 0, 0
    short: list[bytes] = []
    for parts, carried in word_slices(data, words - 1):
        seen += len(parts) - carried
        short = parts
        if len(parts) < words:
            continue
        line = b" ".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(parts) - words + 1].tolist()
        hashes = [xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
        counts += _bit_counts(np.array(hashes, U))
        n += len(hashes)
    if 0 < seen < words:
        counts, n = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(short), seed)], U)), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view(U)[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def distances(values: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ vantage)


def best_split(values: np.ndarray, within: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave the fewest comparisons, or None if none saves enough.

    What lies inside the radius, and what lies outside by no more than ``within``, goes inside; what lies outside goes
    outside. By the triangle inequality two values within ``within`` of each other are then together on one side.
    """
    tried = values[:: max(1, len(values) // TRIED_ON)]
    best, found = WORTH, None
    for vantage in values[:: max(1, len(values) // CANDIDATES)][:CANDIDATES]:
        inside = np.cumsum(np.bincount(distances(tried, vantage), minlength=BITS + within + 1)) / len(tried)
        radii = np.arange(BITS)
        left, right = inside[radii + within], 1 - inside[radii]
        cost = left**2 + right**2
        at = int(cost.argmin())
        if cost[at] < best:
            best, found = float(cost[at]), (vantage, at)
    return found


def sides(values: np.ndarray, vantage: np.uint64, radius: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    away = distances(values, vantage)
    return away <= radius + within, away > radius


class Tree:
    """A vantage-point tree over a sample, which deals fingerprints out to leaves."""

    def __init__(self, sample: np.ndarray, leaves: float, within: int) -> None:
        self.within, self.nodes, self.leaves = within, [], 0
        self.root = self._grow(sample, leaves)

    def _grow(self, sample: np.ndarray, leaves: float) -> int:
        """The number of a node, or of a leaf as ``-1 - leaf``."""
        split = best_split(sample, self.within) if leaves > 1 and len(sample) > CANDIDATES else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        left, right = sides(sample, *split, self.within)
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (
            *split, self._grow(sample[left], leaves * left.mean()), self._grow(sample[right], leaves * right.mean())
        )
        return at

    def deal(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Every leaf that values may have partners in, with these values: all values meet theirs in one leaf at least."""
        waiting = [(self.root, values)]
        while waiting:
            node, values = waiting.pop()
            if not len(values):
                continue
            if node < 0:
                yield -1 - node, values
                continue
            vantage, radius, inner, outer = self.nodes[node]
            left, right = sides(values, vantage, radius, self.within)
            waiting += [(inner, values[left]), (outer, values[right])]


class Groups:
    """Which of some values are linked, directly or through others."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.above = values, list(range(len(values)))

    def find(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def compare(self, at: np.ndarray, within: int) -> None:
        """Compare the values at these places, each with each."""
        own = self.values[at]
        alike = np.bitwise_count(own[:, None] ^ own[None, :]) <= within
        busy = np.flatnonzero(alike.sum(axis=1) > 1)
        left = np.zeros(len(at), bool)
        left[busy] = True
        for i in busy:
            if not left[i]:
                continue
            group, edge = np.zeros(len(at), bool), np.zeros(len(at), bool)
            edge[i] = True
            while edge.any():
                group |= edge
                edge = alike[edge].any(axis=0) & ~group
            left &= ~group
            first = self.find(int(at[i]))
            for j in at[group].tolist():
                root = self.find(j)
                if root != first:
                    self.above[max(root, first)] = first = min(root, first)

    def search(self, within: int) -> None:
        """Link all values within this distance: a tree of splits, and direct comparison where they end."""
        waiting = [np.arange(len(self.values))]
        while waiting:
            at = waiting.pop()
            split = best_split(self.values[at], within) if len(at) > FEW else None
            if split:
                left, right = sides(self.values[at], *split, within)
                waiting += [at[left], at[right]]
                continue
            blocks = np.array_split(at, max(1, math.ceil(len(at) / (2 * FEW))))
            for i, block in enumerate(blocks):  # two at a time, so that a dense set needs no large matrix
                for other in blocks[i + 1 :] or ([] if i else [block[:0]]):
                    self.compare(np.concatenate([block, other]), within)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each linked value with the first one of its group."""
        roots = np.array([self.find(i) for i in range(len(self.values))], np.int64)
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        return self.values[linked], self.values[roots[linked]]


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, node``: each row's fingerprint as a signed number. Null texts are empty; without words it is zero."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "node"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long")


def links_within(nodes: DataFrame, within: int = 2, leaf_rows: int = 8192, block_rows: int = 1_000_000) -> DataFrame:
    """``a, b``: links that connect exactly what distances of at most ``within`` bits connect.

    ``nodes`` has distinct fingerprints in a column ``node``. A tree over a sample of them (by hash, 64 for each leaf to be,
    a million at most) deals all of them out: each goes to the side that it lies on, and where it is just outside a
    vantage point's radius also inside, so that every pair meets in some leaf. A leaf is searched by one task with a tree
    of its own, and returns each value with the first one that it is linked to. A leaf that is too large for that (the
    shared tree is bounded, and fingerprints crowded within a few bits cannot be split) is cut into blocks by hash, and
    every two blocks meet in a task.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    leaves = min(MOST_LEAVES, math.ceil(total / leaf_rows))
    share = math.ceil((1 << 30) * min(1.0, SAMPLE * leaves / max(1, total)))
    picked = nodes.select("node").filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < share).toArrow()
    tree = spark.sparkContext.broadcast(Tree(np.sort(picked["node"].to_numpy()).view(U), leaves, within))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, values in tree.value.deal(batch.column(0).to_numpy().view(U)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), leaf, np.int32)), pa.array(values.view(np.int64))], ["leaf", "node"]
                )

    dealt = stage(nodes.select("node").mapInArrow(deal, "leaf int, node long"), "leaves")
    blocks = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    other = F.explode(F.when(F.col("blocks") > 1, F.array_remove(every, F.col("own"))).otherwise(F.array(F.lit(0))))
    meetings = (
        dealt.join(F.broadcast(blocks), "leaf").withColumn("own", own).withColumn("other", other)
        .select("leaf", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "node")
    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        found = Groups(np.sort(group["node"].to_numpy(np.int64)).view(U))
        found.search(within)
        a, b = found.links()
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return meetings.groupBy("leaf", "first", "second").applyInPandas(search, "a long, b long")


def simhash_components(
    docs: DataFrame, within: int = 2, words: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text",
    leaf_rows: int = 8192, block_rows: int = 1_000_000,
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for each row of ``docs``.

    The fingerprint (16 hexadecimal digits) is over shingles of ``words`` words, ASCII letters lower-cased, words split at
    ASCII white space; a shorter text is one shingle, one without words has fingerprint zero and links like any other.
    Fingerprints that differ in at most ``within`` bits link; ``component_id`` is the smallest id that links lead to.

    Equal fingerprints are one node, so copies cost nothing beyond a partial aggregate. ``links_within`` finds the links
    of distinct ones, ``components`` joins them. No partner is capped or left out.

    Null texts are empty. Rows without an id get the component of rows with an id that links lead to, else null. Rows
    that share an id are judged by their own texts. An empty table gives no rows.
    """
    found = stage(fingerprints(docs, words, seed, key, text), "fingerprints")
    nodes = stage(found.groupBy("node").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links_within(nodes, within, leaf_rows, block_rows))
    homes = stage(
        nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "homes"
    )
    firsts = homes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    homes = homes.join(firsts, "root").select("node", "component_id")
    return found.join(homes, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )
