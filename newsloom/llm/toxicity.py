"""Toxicity: class-conditional Kneser-Ney models of character sequences in words, with shared backoff counts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Sieve, fresh, packed, ship, text_or_empty, unpacked
from newsloom.session import settle, stage

if TYPE_CHECKING:
    import pandas as pd

ORDER = 6
PAD = " " * (ORDER - 1)
EDGES = ".,!?;:\"'()*#%&$|<>-"
CHUNK_CHARS, CHUNK_ROWS = 20_000_000, 150_000  # so many characters, or rows, share one list of words


def normal(word: str) -> str:
    return word.lower().strip(EDGES)


def word_grams(word: str) -> list[str]:
    """Every character of the word and its end, each with those before it; blanks stand before the first."""
    padded = f"{PAD}{word} "
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def log_ratios(grams: pd.DataFrame, discount: float = 0.75) -> dict[str, float]:
    """ln p(character | those before; toxic) - ln p(... ; ordinary), by gram and, for unseen grams, by context.

    The definition in plain form, for small tables; ``estimate`` is the same model as Spark tables.
    Each class has its own counts of whole grams. What a class has not seen falls to one Kneser-Ney model of shorter
    grams over both classes (how many different characters precede them), weighted by the class's own discount mass. A
    gram unseen in both classes has the shared factor on both sides, so the ratio is that of the discount masses.
    """
    import pandas as pd  # not in the workers, which have little memory

    if grams.empty:
        return {}
    g = grams.assign(context=grams.gram.str[:-1], rest=grams.gram.str[1:])
    shared = g.groupby("rest").size()
    levels = [shared]
    for _ in range(ORDER - 2):
        levels.append(levels[-1].groupby(levels[-1].index.str[1:]).size())
    p = levels[-1] / levels[-1].sum()
    for counts in reversed(levels[:-1]):
        by = counts.index.str[:-1]
        total, kinds = counts.groupby(by).transform("sum"), counts.groupby(by).transform("size")
        lower = p.reindex(counts.index.str[1:]).to_numpy()
        p = (np.maximum(counts - discount, 0) + discount * kinds * lower) / total
    g["shared"] = p.reindex(g.rest).to_numpy()
    logs, spare = {}, {}
    for k in ("toxic", "ordinary"):
        total = g.groupby("context")[k].transform("sum")
        kinds = (g[k] > 0).groupby(g.context).transform("sum")
        mass = np.where(total > 0, discount * kinds / total.where(total > 0, 1), 1.0)
        own = np.where(total > 0, np.maximum(g[k] - discount, 0) / total.where(total > 0, 1), 0.0)
        logs[k], spare[k] = np.log(own + mass * g.shared), pd.Series(np.log(mass), g.context)
    out = dict(zip(g.gram, (logs["toxic"] - logs["ordinary"]).astype(float)))
    masses = (spare["toxic"] - spare["ordinary"]).groupby(level=0).first()
    out.update(masses.astype(float).to_dict())
    return out


def estimate(grams: DataFrame, discount: float = 0.75) -> DataFrame:
    """``gram, context, ratio, mass``: the model of ``log_ratios`` from a table ``gram, ordinary, toxic`` of any size.

    Type counts of each shorter level, their context sums and the two classes' sums are tables too; only the number of
    types of the lowest level comes to the driver. Sums by context run over the characters that follow it.
    """
    tail = F.substring("seq", 2, ORDER)
    g = grams.filter("ordinary + toxic > 0").select("gram", "ordinary", "toxic")
    levels = [stage(g.groupBy(F.substring("gram", 2, ORDER).alias("seq")).agg(F.count("*").alias("n")), "toxicity-types")]
    for _ in range(ORDER - 2):
        levels.append(stage(levels[-1].groupBy(tail.alias("seq")).agg(F.count("*").alias("n")), "toxicity-types"))
    types = levels[-1].agg(F.sum("n")).first()[0] or 1
    p = levels[-1].select("seq", (F.col("n") / types).alias("p"))
    for size, counts in zip(range(2, ORDER), reversed(levels[:-1])):
        by = Window.partitionBy("context")
        sums = counts.withColumn("context", F.substring("seq", 1, size - 1)).select(
            "seq", "n", tail.alias("tail"), F.sum("n").over(by).alias("total"), F.count("*").over(by).alias("kinds")
        )
        lower = p.select(F.col("seq").alias("tail"), F.col("p").alias("lower"))
        spread = discount * F.col("kinds") * F.col("lower")
        p = sums.join(lower, "tail").select(
            "seq", ((F.greatest(F.col("n") - discount, F.lit(0.0)) + spread) / F.col("total")).alias("p")
        )
    by = Window.partitionBy("context")
    sums = g.withColumn("context", F.substring("gram", 1, ORDER - 1)).select(
        "gram", "context", "ordinary", "toxic", F.substring("gram", 2, ORDER).alias("seq"),
        *[F.sum(k).over(by).alias(f"total_{k}") for k in ("ordinary", "toxic")],
        *[F.sum((F.col(k) > 0).cast("long")).over(by).alias(f"kinds_{k}") for k in ("ordinary", "toxic")],
    )

    def mass(k: str) -> Column:
        return F.when(F.col(f"total_{k}") > 0, discount * F.col(f"kinds_{k}") / F.col(f"total_{k}")).otherwise(1.0)

    def chance(k: str) -> Column:
        own = F.greatest(F.col(k) - discount, F.lit(0.0)) / F.col(f"total_{k}")
        return F.when(F.col(f"total_{k}") > 0, own).otherwise(0.0) + mass(k) * F.col("p")

    return stage(
        sums.join(p, "seq").select(
            "gram", "context", (F.log(chance("toxic")) - F.log(chance("ordinary"))).alias("ratio"),
            (F.log(mass("toxic")) - F.log(mass("ordinary"))).alias("mass"),
        ),
        "toxicity-model",
    )


class Places(dict):
    """Places of the words, as they are written, in a chunk's list of words in normal form."""

    def __init__(self) -> None:
        super().__init__()
        self.words: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        place = self[word] = self.words.setdefault(normal(word), len(self.words))
        return place


class Grams:
    """The distinct grams of some words in order, and the places of each word's grams among them.

    All characters are numbered together, so that a gram is one number and the grams of a million words are one sort.
    """

    def __init__(self, words: list[str]) -> None:
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        self.sizes = np.where(lengths > 0, lengths + 1, 0).astype(np.int32)
        codes = _codes(" ".join([w for w in words if w]) + " ")  # a word's end is the blank after it
        total = int(self.sizes.sum())
        codes = codes[:total]
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        seen[ord(" ")] = True
        alphabet = np.flatnonzero(seen)
        number = np.zeros(0x110000, np.uint32)
        number[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        blank, numbers = number[ord(" ")], number[codes]
        first = np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)  # where a gram's word begins
        bits = max(1, int(len(alphabet) - 1).bit_length())
        if bits * ORDER <= 64:
            keys = _joined(numbers, first, range(ORDER), bits, blank)
            del first, codes, numbers
            distinct, _, self.at = _ranked(keys)
            del keys
            mask = np.uint64((1 << bits) - 1)
            shifts = np.arange(ORDER - 1, -1, -1).astype(np.uint64) * np.uint64(bits)
            self.characters = alphabet[((distinct[:, None] >> shifts) & mask).astype(np.int64)].astype(np.uint32)
        else:  # two halves of three characters each, by their ranks
            halves = [_joined(numbers, first, part, 21, blank) for part in (range(3), range(3, ORDER))]
            del first, codes, numbers
            ranks = [_ranked(half)[2].astype(np.uint64) for half in halves]
            _, where, self.at = _ranked(ranks[0] << np.uint64(32) | ranks[1])
            distinct = np.stack([half[where] for half in halves], axis=1)
            shifts = np.array([42, 21, 0], np.uint64)
            parts = (distinct[:, :, None] >> shifts) & np.uint64((1 << 21) - 1)
            self.characters = alphabet[parts.reshape(-1, ORDER).astype(np.int64)].astype(np.uint32)

    def __len__(self) -> int:
        return len(self.characters)

    def names(self) -> list[str]:
        return _strings(self.characters)

    def by_context(self, used: np.ndarray) -> tuple[np.ndarray, list[str], list[str]]:
        """Runs of used grams with one context: the first gram's place, the context, the characters that follow it."""
        places = np.flatnonzero(used)
        own = self.characters[places]
        new = np.ones(len(places), bool)
        new[1:] = (own[1:, :-1] != own[:-1, :-1]).any(axis=1) | (np.diff(places) != 1)
        last = _strings(own[:, -1:].reshape(1, -1))[0] if len(places) else ""
        cuts = [*np.flatnonzero(new).tolist(), len(places)]
        return places[new].astype(np.int32), _strings(own[new][:, :-1]), [last[a:b] for a, b in zip(cuts, cuts[1:])]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _strings(characters: np.ndarray) -> list[str]:
    width = characters.shape[1]
    text = np.ascontiguousarray(characters, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + width] for i in range(0, len(text), max(1, width))]


def _joined(numbers: np.ndarray, first: np.ndarray, offsets: range, bits: int, blank: np.uint32) -> np.ndarray:
    """For each place the characters up to it as one number; what lies before its word are blanks."""
    keys = np.zeros(len(numbers), np.uint64)
    here = np.arange(len(numbers), dtype=np.int32)
    for k in offsets:
        back = ORDER - 1 - k
        shifted = numbers if not back else np.concatenate([np.full(min(back, len(numbers)), blank), numbers[:-back]])
        keys <<= np.uint64(bits)
        keys |= np.where(here - back >= first, shifted, blank)
    return keys


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and the rank of every key."""
    order = np.argsort(keys).astype(np.int32)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    distinct = ordered[new]
    del ordered
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return distinct, order[new], rank


COUNTED = ("ordinary", "toxic", "held_ordinary", "held_toxic")  # occurrences in rows that train, and that calibrate
CHUNKS = (
    "chunk long, doc_id array<long>, toxic array<int>, lengths binary, places binary, words binary, "
    "contexts array<struct<start: int, context: string, next: string>>, "
    f"grams array<struct<gram: string, {', '.join(f'{k}: long' for k in COUNTED)}>>"
)
ROW = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("toxic", pa.list_(pa.int32())), ("lengths", pa.binary()),
    ("places", pa.binary()), ("words", pa.binary()),
    ("contexts", pa.list_(pa.struct([("start", pa.int32()), ("context", pa.string()), ("next", pa.string())]))),
    ("grams", pa.list_(pa.struct([("gram", pa.string()), *[(k, pa.int64()) for k in COUNTED]]))),
])


def _chunk(number: int, words: list[str], rows: list[tuple[int, int, np.ndarray]], learns: bool) -> pa.RecordBatch:
    found = Grams(words)
    used, grams = np.ones(len(found), bool), []
    if learns:
        counts = []
        for k in range(len(COUNTED)):
            of = [places for _, kind, places in rows if kind == k]
            seen = np.bincount(np.concatenate(of), minlength=len(words)) if of else np.zeros(len(words), np.int64)
            counts.append(np.bincount(found.at, np.repeat(seen, found.sizes), len(found)).astype(np.int64))
        used = counts[2] + counts[3] > 0
        grams = pa.StructArray.from_arrays([pa.array(found.names(), pa.string()), *map(pa.array, counts)], ["gram", *COUNTED])
        rows = [row for row in rows if row[1] > 1]
    starts, contexts, following = found.by_context(used)
    del found
    entries = pa.StructArray.from_arrays(
        [pa.array(starts, pa.int32()), pa.array(contexts, pa.string()), pa.array(following, pa.string())],
        ["start", "context", "next"],
    )

    def one(values, kind: pa.DataType) -> pa.Array:
        """A list column of one row."""
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind.value_type))

    steps = [np.diff(places, prepend=np.int32(0)) for *_, places in rows]
    columns = [
        pa.array([number]), one([r[0] for r in rows], ROW.field("doc_id").type),
        one([r[1] & 1 for r in rows], ROW.field("toxic").type),
        pa.array([packed(np.array([len(x) for x in steps], np.int32))]),
        pa.array([packed(np.concatenate([np.zeros(0, np.int32), *steps]))]),
        pa.array([zlib.compress("\n".join(words).encode(), 1)]), one(entries, ROW.field("contexts").type),
        one(grams, ROW.field("grams").type),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=ROW)


def _chunks(learns: bool):
    """Texts as chunks: the distinct words of some thousand texts, and each text as sorted places in that list.

    Where texts teach, the grams come with their occurrences by class, and only texts that calibrate are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known, rows, size = Places(), [], 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            kinds = batch.column("kind") if learns else None
            for i in range(batch.num_rows):  # one text at a time: a batch of them as Python strings would be large
                text = texts[i].as_py()
                words = text.split()
                places = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                places.sort()
                rows.append((ids[i].as_py(), kinds[i].as_py() if learns else 0, places))
                size += len(text)
                if size >= CHUNK_CHARS or len(rows) >= CHUNK_ROWS:
                    del words
                    distinct, known = list(known.words), Places()
                    yield _chunk(number, distinct, rows, learns)
                    number += 1
                    rows, size = [], 0
        if rows:
            distinct = list(known.words)
            del known
            yield _chunk(number, distinct, rows, learns)

    return run


def chunks_of(rows: DataFrame, learns: bool = False) -> DataFrame:
    """Chunks of ``doc_id, text`` (and ``kind``, a place in ``COUNTED``), written once."""
    return stage(rows.mapInArrow(_chunks(learns), CHUNKS), "toxicity")


FEATURES = ("mean_ratio", "telling_ratio", "three_ratio", "word_ratio")
RATIOS = ", ".join(f"{name} double" for name in FEATURES)


def ratio_features(values: np.ndarray) -> tuple[float, ...]:
    """Log-likelihood ratio for each word: of all words, of the most telling fiftieth, the three and the one most telling."""
    if not len(values):
        return (0.0,) * len(FEATURES)
    values = np.sort(values)[::-1]
    telling = -(-len(values) // 50)
    return tuple(float(values[:n].mean()) for n in (len(values), telling, 3, 1))


def _values_of_words(row: dict) -> np.ndarray:
    """The log-likelihood ratio of each word of a chunk."""
    grams = Grams(zlib.decompress(row["words"].as_py()).decode().split("\n"))
    of_gram = np.zeros(len(grams))
    if row["found"].is_valid:
        start, ratios = (row["found"].values.field(c) for c in ("start", "ratios"))
        lengths = ratios.value_lengths().to_numpy()
        first = np.cumsum(lengths) - lengths
        slots = np.repeat(start.to_numpy() - first, lengths) + np.arange(lengths.sum())
        of_gram[slots] = ratios.flatten().to_numpy()
    of_word = np.zeros(len(grams.sizes))
    filled = np.flatnonzero(grams.sizes)  # only an empty word has no grams
    if len(filled):
        of_word[filled] = np.add.reduceat(of_gram[grams.at], (np.cumsum(grams.sizes) - grams.sizes)[filled])
    return of_word


def _features_of_chunk(row: dict) -> np.ndarray:
    of_word = _values_of_words(row)
    lengths = unpacked(row["lengths"].as_py())
    texts = np.split(unpacked(row["places"].as_py()), np.cumsum(lengths)[:-1]) if len(lengths) else []
    return np.array([ratio_features(of_word[np.cumsum(t)]) for t in texts]).reshape(-1, len(FEATURES))


def _features(weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                x = _features_of_chunk(row)
                columns, names = [row["doc_id"].values, *map(pa.array, x.T.copy())], ["doc_id", *FEATURES]
                if weights is None:
                    columns, names = [*columns, row["toxic"].values], [*names, "toxic"]
                else:
                    p = probability(x, weights)
                    columns += [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                    names += ["score", "predicted"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def features(chunks: DataFrame, model: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``doc_id``, the ratios and, without weights, ``toxic`` of the texts in chunks, else ``score, predicted``.

    The distinct grams of a chunk, by context, meet the model by a join and come back to it as one list; the texts
    themselves do not move. A gram that the model lacks has what its context gives, or 0.
    """
    by_context = model.groupBy("context").agg(
        F.min("mass").alias("mass"),
        F.map_from_entries(F.collect_list(F.struct(F.substring("gram", ORDER, 1), "ratio"))).alias("known"),
    )

    def ratio(i: Column) -> Column:
        known = F.try_element_at("known", F.substring(F.col("next"), i, F.lit(1)))
        return F.coalesce(known, F.col("mass"), F.lit(0.0)).cast("float")

    found = (
        chunks.select("chunk", F.inline("contexts")).join(by_context, "context")
        .select("chunk", "start", F.transform(F.sequence(F.lit(1), F.char_length("next")), ratio).alias("ratios"))
        .groupBy("chunk").agg(F.collect_list(F.struct("start", "ratios")).alias("found"))
    )
    rows = chunks.select("chunk", "doc_id", "toxic", "lengths", "places", "words")
    more = "toxic int" if weights is None else "score double, predicted int"
    return rows.join(found, "chunk", "left").mapInArrow(_features(weights), f"doc_id long, {RATIOS}, {more}")


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic function of the ratios; the logit is kept within what a double can tell from 0 and 1."""
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on the ratios by Newton's method; one class only gives its share for every text."""
    share = y.sum() / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return np.array([math.log((share + 1e-6) / (1 - share + 1e-6)), *np.zeros(x.shape[1])])
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    design = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    penalty = ridge * len(x) * np.diag([0.0, *np.ones(x.shape[1])])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + w @ penalty @ w / 2)

    w = np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, design.T @ (p - y) + penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):  # steps that overshoot are halved
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return np.array([w[0] - slopes @ middle, *slopes])


def part_of(key: str = "doc_id"):
    """crc32 of the id's digits modulo 5: 0 is held out from all learning, the sample that calibrates is from 1."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", calibration_rows: int = 50_000):
    """The model as a table, and the weights of the score.

    The weights are fitted on a sample by a model that does not know it; then the sample teaches the model too.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    known = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    known_rows = known.filter(part_of() != 0).count()
    share = min(1.0, 4 * calibration_rows / max(known_rows, 1))  # of the fifth that calibrates, a quarter of the rows
    sampled = (part_of() == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    kind = F.col("toxic") + F.when(sampled, 2).otherwise(0)
    learn = chunks_of(
        Sieve(known.select("doc_id")).sift(rows.filter(part_of() != 0), "doc_id")
        .join(known.filter(part_of() != 0).hint("shuffle_hash"), "doc_id")
        .select("doc_id", "text", kind.cast("int").alias("kind")),
        learns=True,
    )
    grams = stage(
        learn.select(F.inline("grams")).groupBy("gram").agg(*[F.sum(k).alias(k) for k in COUNTED]), "toxicity-grams"
    )
    trained = estimate(grams.select("gram", "ordinary", "toxic"))
    sample = (
        features(learn, trained)
        .orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(calibration_rows)
        .toArrow().to_pandas()
    )
    weights = calibrate(sample[list(FEATURES)].to_numpy(float), sample["toxic"].to_numpy(float))
    both = [(F.col(k) + F.col(f"held_{k}")).alias(k) for k in ("ordinary", "toxic")]
    return estimate(grams.select("gram", *both)), weights


def score(rows: DataFrame, model: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id``, the ratios, ``score, predicted`` of ``doc_id, text``."""
    return features(chunks_of(rows), model, weights)


def toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", calibration_rows: int = 50_000
) -> DataFrame:
    """``doc_id``, the ratios, ``score, predicted``: one row for each row of ``docs``.

    Two Kneser-Ney models, of the toxic and of the ordinary labelled texts, give every word a log-likelihood ratio,
    from its characters and those before them, so that rare forms of an expression are known by their parts. A text is
    judged by length-normalised ratios: the mean over its words, and the means over the fiftieth, the three and the one
    that tell most (a single insult in a long text). A logistic function of these is the score. Its weights are fitted
    on rows that the models did not know then.

    Learning uses labelled rows outside the held-out fifth, all of them for the counts, of which every gram is in the
    model. The weights are fitted on about ``calibration_rows`` of them at most, chosen by a hash of the id, with a model
    of all the others; the sample's counts are added afterwards. The model is a table, which the distinct grams of some thousand texts at a time are joined with. ``labels`` has ``doc_id, toxic``; several labels of an id count as toxic if one is. Ids or labels that are
    null teach nothing. Null and empty texts have ratios 0 and get the score that goes with them; without labels every
    score is near 0; an empty table gives no rows.
    """
    model, weights = fit(docs, labels, key, text, calibration_rows)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return score(rows, model, weights)


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` does not predict to be toxic, all columns as they are.

    A verdict follows from the text, so toxic texts are known by a 64-bit hash; only rows that a sieve holds move. Null
    texts are empty; repeated rows share a verdict; an empty table gives no rows; no column name can clash.
    """
    digest, name = F.xxhash64(text_or_empty(text)), fresh(docs, "_digest")

    def found() -> DataFrame:
        judged = score(
            docs.select(digest.alias("doc_id"), text_or_empty(text).alias("text")), *fit(docs, labels, key, text)
        )
        return judged.filter("predicted = 1").select(F.col("doc_id").alias(name)).distinct()

    toxic = settle(docs.sparkSession, found, "toxicity-found")
    sieve, rows = Sieve(toxic), docs.withColumn(name, digest)
    held = sieve.sift(rows, name).join(toxic.hint("shuffle_hash"), name, "left_anti").select(*rows.columns)
    return sieve.sift(rows, name, passing=False).unionByName(held).select(*[F.col(f"`{c}`") for c in docs.columns])
