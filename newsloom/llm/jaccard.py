"""N-gram Jaccard join by vertical partitioning: fragments of the global shingle order, partial overlaps, sums."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Sieve, U, fresh, mixed, ship, text_or_empty
from newsloom.llm.components import components
from newsloom.session import settle, stage

KNOWN_WORDS = 1 << 20  # a task forgets its words beyond this many
KNOWN_SETS = 1 << 20  # and the sets it has met
BLOCK_TEXTS = 1500  # texts of a block, on average
FRAGMENT = 4096  # shingles of the order whose overlaps are counted at a time
LEAST_BITS, MOST_BITS = 22, 26  # of the sketch, which has a byte for each counter
HELD_SLOTS = 4 << 20  # counters that a task meets before it sends them


class WordHashes(dict):
    """64-bit hashes of the words of one task, kept by number so that a text's are one array look-up."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1 << 12, U)

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[number] = xxhash.xxh3_64_intdigest(word)
        self[word] = number
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > KNOWN_WORDS and self:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[numbers]


def shingle_set(text: str, known: WordHashes, words: int = 3) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes in ascending order, which is the global order."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # both look at ASCII only
    if not parts:
        return np.zeros(0, U)
    h = known.of(parts)
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, width, U)
    for i in range(width):
        total = mixed(total + h[i : len(h) - width + 1 + i])
    return np.unique(total)


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers of 32 bits, byte by byte, so that the high ones, which are mostly 0, take no room."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def rarity(counts: np.ndarray) -> np.ndarray:
    """A byte that grows with the count: exact up to 16, in steps of 6 % beyond."""
    coded = np.round(12 * np.log2(np.maximum(counts, 1) / 16.0) + 16)
    return np.where(counts <= 16, counts, np.clip(coded, 17, 255)).astype(np.uint8)


def bits_for(texts: DataFrame) -> int:
    """As many counters as there are words, or some more, between ``2**LEAST_BITS`` and ``2**MOST_BITS``."""
    chars = texts.agg(F.sum(F.length(texts.columns[0]))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (chars // 5).bit_length()))


def sketch(texts: DataFrame, words: int, bits: int) -> np.ndarray:
    """About how many sets hold each shingle (``rarity``): ``2**bits`` counters by hash, however many shingles there are.

    Tasks send the counters that they have met, packed, in pieces; the pieces are summed as they come in.
    """
    pieces = 1 << min(6, bits)
    width = (1 << bits) // pieces

    def flushed(met: list[np.ndarray]) -> pa.RecordBatch:
        slots, counts = np.unique(np.concatenate(met), return_counts=True)
        ends = np.searchsorted(slots, np.arange(pieces + 1) * width)
        parts = [(k, slots[a:b] - k * width, counts[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in parts], pa.int32()),
             pa.array([packed(np.diff(at, prepend=0)) for _, at, _ in parts], pa.binary()),
             pa.array([packed(n) for _, _, n in parts], pa.binary())],
            ["piece", "steps", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met, held = WordHashes(), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                met.append(slots_of(shingle_set(text, known, words), bits))
                held += len(met[-1])
                if held >= HELD_SLOTS:
                    yield flushed(met)
                    met, held = [], 0
        if held:
            yield flushed(met)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, steps, counts in zip(*(batch.column(c).to_pylist() for c in ("piece", "steps", "counts"))):
                total = sums.setdefault(piece, np.zeros(width, np.int64))
                total[np.cumsum(unpacked(steps), dtype=np.int64)] += unpacked(counts)
        coded = [zlib.compress(rarity(s).tobytes(), 1) for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(coded, pa.binary())], ["piece", "counters"])

    sent = texts.mapInArrow(count, "piece int, steps binary, counts binary").repartition(pieces, "piece")
    totals = np.zeros((pieces, width), np.uint8)
    for row in sent.mapInArrow(add, "piece int, counters binary").collect():
        totals[row.piece] = np.frombuffer(zlib.decompress(row.counters), np.uint8)
    return totals.reshape(-1)


def slots_of(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(shingles) >> U(64 - bits)).astype(np.int64)


def prefix(shingles: np.ndarray, counters: np.ndarray, bits: int, share: int) -> np.ndarray:
    """The first fragment of the set in the global order: rare shingles first, by the sketch and then by hash.

    Sets of similarity ``share`` have at least that share of each in common, so the first shingle that they have in
    common lies within this many of the first in both. One that was counted once, over all texts, is in no other text and
    is left out.
    """
    n = len(shingles)
    counts = counters[slots_of(shingles, bits)]
    order = np.argsort(counts, kind="stable")[: n - (share * n + 99) // 100 + 1]
    return shingles[order[counts[order] > 1]]


class Segments:
    """Cuts a set at fixed places of the global order, so finely that similar sets have a segment alike.

    Sets of similarity ``share`` differ in at most ``(|A| + |B|) (100 - share) / (100 + share)`` shingles; with more
    segments than that, one is the same in both. Sizes are put into classes narrow enough that similar sets lie in one
    class or in neighbouring ones; the cut of a class is fine enough for its largest sets, and each set is cut as its
    own class and as the next one. Empty segments say nothing and are left out where enough others remain, which a few
    segments more make sure of for nearly every set.
    """

    def __init__(self, share: int) -> None:
        self.share, self.lows = share, [1]

    def _low(self, k: int) -> int:
        while len(self.lows) <= k:
            last = self.lows[-1]
            self.lows.append(max(last + 1, (last - 1) * 100 // self.share + 1))
        return self.lows[k]

    def _class_of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self._low(len(self.lows))
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A 64-bit key of each segment's place and content."""
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(shingles + U(0x632BE59BD9B4E019)), dtype=U)])
        k, out = self._class_of(len(shingles)), []
        for c in (k, k + 1):
            differ = 2 * (self._low(c + 1) - 1) * (100 - self.share) // (100 + self.share)
            n = differ + 1 + (differ // 10 + 2 if differ else 0)
            cuts = np.arange(1, n, dtype=U) * U(min((1 << 64) // n, (1 << 64) - 1))
            at = np.concatenate([[0], np.searchsorted(shingles, cuts), [len(shingles)]])
            keys = mixed(sums[at[1:]] - sums[at[:-1]] + mixed(np.arange(n, dtype=U) + U(c + 1) * U(1 << 32)))
            filled = at[1:] > at[:-1]
            out.append(keys[filled] if filled.sum() > differ else keys)
        return np.concatenate(out)


def node_of(shingles: np.ndarray) -> int:
    """A number for the set: texts of the same set are one node."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


def _cut_sets(counters, bits: int, share: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met, segments = WordHashes(), set(), Segments(share)
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, known, words)
                node = node_of(shingles) if len(shingles) else None
                sizes.append(len(shingles))
                nodes.append(node)
                if node is None or node in met:  # nothing to link, or a copy of a set that this task has sent
                    keys.append(None)
                    continue
                if len(met) >= KNOWN_SETS:
                    met.clear()
                met.add(node)
                found = prefix(shingles, counters.value, bits, share) if counters else segments.keys(shingles)
                keys.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "keys"],
            )

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share: counted fragment by fragment of the common order, then summed."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    together = np.concatenate(sets)
    order = np.argsort(together, kind="stable")
    together, owner = together[order], owner[order]
    new = np.concatenate([[True], together[1:] != together[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    number, owner = np.unique(number[shared], return_inverse=True)[1], owner[shared]
    total = np.zeros((len(sets), len(sets)), np.float64)
    at = 0
    while at < len(number):
        first = number[at]
        end = int(np.searchsorted(number, first + FRAGMENT))
        part = np.zeros((len(sets), int(number[end - 1] - first) + 1), np.float32)
        part[owner[at:end], number[at:end] - first] = 1
        total += part @ part.T
        at = end
    return total


def linked_groups(nodes: list[int], sets: list[np.ndarray], share: int) -> list[tuple[int, int]]:
    """Each node with the smallest node that links between these sets lead to; nodes without links are left out."""
    sizes = np.array([len(s) for s in sets])
    common = overlaps(sets)
    alike = (100 + share) * common >= share * (sizes[:, None] + sizes[None, :])
    out, left = [], np.ones(len(sets), bool)
    for i in np.argsort(nodes):
        if not left[i]:
            continue
        group, edge = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
        edge[i] = True
        while edge.any():
            group |= edge
            edge = alike[edge].any(axis=0) & ~group
        left &= ~group
        out += [(nodes[j], nodes[i]) for j in np.flatnonzero(group) if j != i]
    return out


def _link_blocks(share: int, words: int):
    """Rows come in order of (family, first, second); each run of equal ones holds the texts of one pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        at, members = None, {}

        def links() -> pa.RecordBatch:
            found = linked_groups(list(members), list(members.values()), share) if len(members) > 1 else []
            a, b = zip(*found) if found else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (a, b)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "first", "second", "node", "text")]
            for family, first, second, node, text in zip(*columns):
                if (family, first, second) != at:
                    if len(members) > 1:
                        yield links()
                    at, members = (family, first, second), {}
                if node not in members:
                    shingles = shingle_set(text, known, words)
                    if node_of(shingles) == node:
                        members[node] = shingles
        if len(members) > 1:
            yield links()

    return run


def jaccard_components(
    docs: DataFrame, share: int = 90, words: int = 3, key: str = "doc_id", text: str = "text",
    block_shingles: int = 2_000_000, rare_first: bool = False, sketch_bits: int | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row for each row of ``docs``.

    A text's set holds its distinct shingles of ``words`` words (ASCII letters lower-cased, words split at ASCII white
    space); a shorter text is one shingle as a whole, one without words has the empty set and links with nothing. Two
    texts link when 100 |A and B| >= ``share`` |A or B|; ``component_id`` is the smallest id that links lead to.

    1. The global order of shingles (their hashes) is cut vertically, and what two sets have alike in a fragment makes
       them candidates: a whole segment of the set's size class (``Segments``), or, if ``rare_first``, one shingle of
       the first fragment of an order in which rare shingles come first (``prefix``, by a sketch with as many counters as there are words, up to 2**26, or ``2**sketch_bits``). Both
       miss no similar pair. Segments hold some ``100 / (100 - share)`` shingles, which suits high similarities; rare
       shingles suit lower ones, if shingles are long enough not to meet by chance. Equal sets are one node.
    2. Nodes with something alike, and sizes that can be similar, are joined in chains by size, which is enough to find
       the families of candidates, as connected components.
    3. Links exist only within a family. Its texts are dealt into blocks by size class and hash, of about
       ``block_shingles`` shingles or ``BLOCK_TEXTS`` texts, and every two blocks that can hold similar sizes meet in one task, which counts
       the overlaps of all its pairs fragment by fragment, sums them, and returns each text with the smallest one it
       is linked to. No pair is ever a row, and no family is one task's work.
    4. Components of these links are the answer. No partner or candidate is capped or left out.

    Null texts are empty. Rows without an id get the component of an equal set that has an id, else null. Rows that
    share an id are judged by their own texts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    counters = None
    if rare_first:
        sketch_bits = sketch_bits or bits_for(rows.select("text"))
        counters = spark.sparkContext.broadcast(sketch(rows.select("text"), words, sketch_bits))
    cut = stage(
        rows.mapInArrow(
            _cut_sets(counters, sketch_bits, share, words), "doc_id long, n_shingles long, node long, keys array<long>"
        ),
        "sets",
    )

    by_size = Window.partitionBy("key").orderBy("n", "node")
    candidates = (
        cut.filter("keys IS NOT NULL").select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
        .select(
            "n", F.col("node").alias("a"), F.lag("node").over(by_size).alias("b"), F.lag("n").over(by_size).alias("_n")
        )
        .filter(F.col("b").isNotNull() & (F.col("a") != F.col("b")) & (F.col("n") * share <= F.col("_n") * 100))
        .select("a", "b")
    )
    families = components(candidates)

    classes = cut.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n")
    )
    links = _verified(rows, classes, families, share, words, block_shingles)
    roots = components(links).withColumnRenamed("root", "_root")

    homes = stage(
        classes.join(roots, "node", "left").select("node", "first_id", F.coalesce("_root", "node").alias("_root")),
        "homes",
    )
    firsts = homes.groupBy("_root").agg(F.min("first_id").alias("component_id"))
    homes = homes.join(firsts, "_root").select("node", "component_id")
    found = cut.select("doc_id", "n_shingles", "node")
    return (
        found.filter("node IS NOT NULL").join(homes, "node").select("doc_id", "n_shingles", "component_id")
        .unionByName(found.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def one_of_each(
    docs: DataFrame, share: int = 90, words: int = 3, key: str = "doc_id", text: str = "text", rare_first: bool = False
) -> DataFrame:
    """One row of each component of ``jaccard_components``, that of the smallest id, all columns as they are.

    Rows without an id stay. Of rows that share the smallest id, those that are equal in every column are one.
    """
    found = settle(
        docs.sparkSession, lambda: jaccard_components(docs, share, words, key, text, rare_first=rare_first), "found"
    )
    own, count, whole = (fresh(docs, name) for name in ("_id", "_rows", "_whole"))
    kept = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(count))
    # Only rows that may have to go, or that share an id, are moved and joined.
    doubtful = found.groupBy("doc_id").agg(F.count("*").alias("_rows"), F.min("component_id").alias("_first"))
    sieve = Sieve(doubtful.filter("_rows > 1 OR _first <> doc_id").select("doc_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stays = sieve.sift(docs, key).join(kept.hint("shuffle_hash"), F.col(f"`{key}`") == F.col(own))
    once = stays.filter(F.col(count) == 1).select(*columns)
    # rows of any type, maps among them, are compared as text
    more = stays.filter(F.col(count) > 1).select(*columns).withColumn(whole, F.to_json(F.struct(*columns)))
    return sieve.sift(docs, key, passing=False).unionByName(once).unionByName(more.dropDuplicates([whole]).drop(whole))


def _verified(
    rows: DataFrame, classes: DataFrame, families: DataFrame, share: int, words: int, block_shingles: int
) -> DataFrame:
    """``a, b``: for each node the smallest node it is linked with inside some pair of blocks."""
    # Sizes whose logarithms differ by one class or less can be similar; wider apart they cannot.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / share) * 1.000001)).cast("int")
    members = stage(
        families.select("node", F.col("root").alias("family")).join(classes, "node").withColumn("band", band), "members"
    )
    blocks = members.groupBy("family", "band").agg(
        F.ceil(F.greatest(F.sum("n") / F.lit(block_shingles), F.count("*") / F.lit(BLOCK_TEXTS))).cast("int").alias("blocks")
    )
    above = blocks.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_above"))
    below = blocks.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_below"))
    sizes = blocks.join(above, ["family", "band"], "left").join(below, ["family", "band"], "left")

    def name(b, i):
        return b.cast("long") * F.lit(1 << 32) + i

    def others(shift: int, count: str):
        n = F.coalesce(F.col(count), F.lit(0))
        all_of = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(all_of, lambda i: name(F.col("band") + shift, i))

    # A meeting compares all its texts, those of one block included; a block alone meets itself.
    everyone = F.concat(others(0, "blocks"), others(-1, "blocks_below"), others(1, "blocks_above"))
    placed = (
        members.join(sizes, ["family", "band"])
        .withColumn("_own", name(F.col("band"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
        .withColumn("_others", F.array_remove(everyone, F.col("_own")))
        .withColumn("_other", F.explode(F.when(F.size("_others") > 0, F.col("_others")).otherwise(F.array("_own"))))
        .select(
            F.col("first_id").alias("doc_id"), "node", "family",
            F.least("_own", "_other").alias("first"), F.greatest("_own", "_other").alias("second"),
        )
    )
    pairs = Sieve(placed.select("doc_id").distinct()).sift(rows, "doc_id").join(placed.hint("shuffle_hash"), "doc_id")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        pairs.repartition(parts, "family", "first", "second").sortWithinPartitions("family", "first", "second")
        .mapInArrow(_link_blocks(share, words), "a long, b long")
    )
