"""A positional index of the words of texts, kept batch by batch, and the search for terms in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import let
from newsloom.operators.joins import word_hooks, wanted_terms
from newsloom.session import stage
from newsloom.sources.manifest import Manifests

POSTING = "word string, id long, pos int, before string, after string"
PIECE_CHARS = 16 << 20  # texts whose postings one task sorts
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20)}
HELD_BITS = 24  # of a bitmap of words


class WordIndex:
    """Which word of which text stands where, so that terms are found without reading the texts again.

    A text is its words in lower case, cut at single spaces (two spaces have an empty word between them). A batch writes
    its postings ``word, id, pos`` with the words before and after, sorted by buckets of words, and the number of texts
    that each word occurs in; the list of batches (``Manifests``) is written last, so a batch that fails is written over by
    the next attempt and one that is delivered again changes nothing. Ids are unique over all batches. Null texts have no
    words.

    Texts, which are smaller, are dealt out before they are cut into words: no word, however common, is one task's, and
    each task sorts the postings of some ``PIECE_CHARS`` characters. They are one file, in which the words of all buckets
    are listed once for each column (``PACKED``) and a bucket is a range of pages.

    Searching is exact and equal to ``match_term_table`` over the texts of all batches: a term is looked up by its rarest
    word. Terms of up to three words are decided by the words beside it, as the postings come by; what is left of longer
    ones is looked up by position.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifests = Manifests(spark, f"{self.folder}/manifests")
        self.buckets = (self.manifests.last() or {}).get("buckets", buckets)

    def batches(self) -> list[int]:
        return (self.manifests.last() or {}).get("batches", [])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int")

    def add(self, batch: int, texts: DataFrame, column: str = "content") -> bool:
        """Index ``texts(id, column)`` under the batch's number; False if that is there already."""
        done = self.batches()
        if batch in done:
            return False
        kept = texts.where(F.col("id").isNotNull() & F.col(column).isNotNull()).select(
            F.col("id").cast("long").alias("id"), F.col(column).alias("_text")
        )
        words = F.split(F.lower("_text"), " ")
        chars = kept.agg(F.sum(F.length("_text"))).first()[0] or 0
        listed = let(words, lambda ws: F.transform(ws, lambda w, i: F.struct(
            w.alias("word"), i.alias("pos"), F.get(ws, i - 1).alias("before"), F.get(ws, i + 1).alias("after")
        )))
        dealt = kept.repartition(-(-chars // PIECE_CHARS) or 1, "id").select("id", F.explode_outer(listed).alias("_p"))
        placed = dealt.select("_p.word", "id", "_p.pos", "_p.before", "_p.after").withColumn("_bucket", self._bucket())
        ordered = placed.sortWithinPartitions("_bucket", "word", "id", "pos")
        ordered.write.mode("overwrite").options(**PACKED).parquet(f"{self.folder}/postings/{batch}")
        held = kept.select(F.explode_outer(F.array_distinct(words)).alias("word"))
        counted = held.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
        counted.write.mode("overwrite").options(**PACKED).parquet(f"{self.folder}/words/{batch}")
        self.manifests.commit({"buckets": self.buckets, "batches": sorted([*done, batch])})
        return True

    def _postings(self, batches: list[int], buckets: list[int] | None = None) -> DataFrame:
        """``word, id, pos, before, after`` of some batches, of some buckets if named."""
        schema = f"{POSTING}, _bucket int"
        parts = self.spark.createDataFrame([], schema)
        for batch in batches:
            parts = parts.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/postings/{batch}"))
        if buckets is not None:
            parts = parts.where(F.col("_bucket").isin(buckets))
        return parts.drop("_bucket")

    def vocabulary(self) -> DataFrame:
        """``word, texts``: every word and the number of texts that it occurs in."""
        paths = [f"{self.folder}/words/{b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], "word string, texts long")
        counted = self.spark.read.schema("word string, texts long").parquet(*paths)
        return counted.groupBy("word").agg(F.sum("texts").alias("texts"))

    def search(self, terms: DataFrame, gram: int = 4) -> DataFrame:
        """``id, term``: which terms occur, in any case, in which texts."""
        wanted = wanted_terms(terms)
        hooks = stage(word_hooks(wanted, stage(self.vocabulary(), "vocabulary"), gram), "hooks")
        sure, unsure = hooks.where(F.size("sure") > 0), hooks.where(F.size("unsure") > 0)
        # the terms of a word travel as one row, and are set apart where all that is found in a text has come together
        listed = self._holding(sure).join(sure.select("word", "sure"), "word").select("id", "sure").repartition("id")
        whole = listed.select("id", F.explode_outer("sure").alias("no")).distinct()
        anchors = unsure.select("word", F.explode_outer("unsure").alias("no"))
        return whole.unionByName(self._phrases(wanted, anchors)).join(
            wanted.select("no", "term"), "no"
        ).select("id", "term")

    def _holding(self, words: DataFrame) -> DataFrame:
        """The postings of these words, and few others: those in their buckets that a bitmap of the words lets pass."""
        buckets = [r["b"] for r in words.select(self._bucket().alias("b")).distinct().collect()]  # as many as there are, at most
        slot = F.shiftrightunsigned(F.xxhash64("word"), 64 - HELD_BITS)
        place, bit = F.shiftright(slot, 6).alias("_place"), F.pmod(slot, F.lit(64)).cast("int")
        bitmap = words.select(place, bit.alias("_bit")).groupBy("_place").agg(
            F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask")
        )  # 2 ** (HELD_BITS - 6) rows at most
        near = self._postings(self.batches(), buckets).withColumn("_place", place)
        passing = near.join(F.broadcast(bitmap), "_place").where(F.getbit("_mask", bit) == 1)
        return passing.drop("_place", "_mask")

    def _phrases(self, wanted: DataFrame, hooks: DataFrame) -> DataFrame:
        """``id, no`` of the terms of several words whose words stand next to each other; ``hooks(word, no)``.

        Wherever a term's anchor stands, the words on both sides have to be those of the term. The first word need only end
        with the term's beginning, and the last only begin with its end. Where more words are left, every word is looked up
        by its place among the postings of the same texts, or is beside one that is: of a word and its neighbours, the
        longest inner one is looked up, which is seldom a common one.
        """
        split = wanted.select("no", F.split("needle", " ").alias("_p")).withColumn("n", F.size("_p")).where("n > 1")

        def longest(j: Column) -> Column:
            near = F.filter(F.array(j - 1, j, j + 1), lambda k: (k > 0) & (k < F.col("n") - 1))
            return -F.array_max(F.transform(near, lambda k: F.struct(F.length(F.get("_p", k)).alias("size"), (-k).alias("k"))))["k"]

        split = split.withColumn("looked", F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - 1), longest)))
        pieces = split.select("no", "n", "looked", "_p", F.posexplode_outer("_p").alias("k", "piece")).select(
            "no", "n", "looked", "k", "piece", F.get("_p", F.col("k") - 1).alias("left"), F.get("_p", F.col("k") + 1).alias("right")
        )
        n, k = F.col("n"), F.col("k")

        def fits(word: Column, piece: Column, place: Column) -> Column:
            return F.when(place == 0, word.endswith(piece)).when(place == n - 1, word.startswith(piece)).otherwise(word == piece)

        beside = (F.col("left").isNull() | fits(F.col("before"), F.col("left"), k - 1)) & (
            F.col("right").isNull() | fits(F.col("after"), F.col("right"), k + 1)
        )
        anchors = stage(hooks.join(pieces.drop("looked"), "no").where(fits(F.col("word"), F.col("piece"), k)), "anchors")
        met = self._holding(anchors).join(anchors, "word").where(beside & (F.col("pos") >= k))
        starts = stage(met.select("no", "id", (F.col("pos") - k).alias("start"), ((k <= 1) & (k >= n - 2)).alias("sure")), "starts")

        open_ = starts.where("NOT sure").select("no", "id", "start").distinct()
        inner = pieces.where(F.array_contains("looked", k)).withColumn("n_looked", F.size("looked"))
        inner = inner.drop("looked").withColumnRenamed("piece", "word")
        places = stage(open_.join(inner, "no").withColumn("pos", F.col("start") + k), "places")
        near = self._holding(places)
        for key in ("word", "id"):
            near = near.join(places.select(key).distinct(), key, "left_semi")
        standing = places.join(near, ["word", "id", "pos"]).where(beside)
        counted = standing.groupBy("no", "id", "start", "n_looked").agg(F.count_distinct("k").alias("fitting"))
        settled = starts.where("sure").select("id", "no").unionByName(counted.where("fitting = n_looked").select("id", "no"))
        return settled.distinct()
