"""Keyed look-ups, anti joins and term matching.

Look-up tables are first reduced to one row per key, so a join never multiplies rows. No side is broadcast by
hand: Spark broadcasts a side only when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``, and AQE
splits the partitions of hot keys otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates, text
from newsloom.functions.rows import compute_once
from newsloom.operators import scoring
from newsloom.operators.ranking import first_per_group, first_per_key
from newsloom.session import stage


def join_metadata(links: DataFrame, metadata: DataFrame) -> DataFrame:
    """Page metadata by link URL; links without metadata, or whose page has no title, drop out."""
    known = metadata.where(F.col("title").isNotNull()).select(
        "url", F.col("title").alias("page_title"), "date"
    )
    known = first_per_key(known, "url", ["date", "page_title"])
    return links.join(known, "url", "inner")


def join_content(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Fill in missing content by URL; content that is there stays, and those rows are not moved."""
    there = F.coalesce(F.length("content"), F.lit(0)) > 0
    missing = articles.where(~there)
    needed = texts.join(missing.select("url").distinct(), "url", "left_semi")
    fetched = needed.groupBy("url").agg(F.min("content").alias("_text"))
    filled = missing.join(fetched, "url", "left").withColumn("content", F.col("_text")).drop("_text")
    return articles.where(there).unionByName(filled)


def exclude_seen(links: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    return links.join(seen.select(key).distinct(), key, "left_anti")


def exclude_known(links: DataFrame, known: DataFrame, order: Sequence[str], key: str = "url") -> DataFrame:
    """Links whose URL is not known already from a link at or before their place."""
    places = known.select(F.col(key).alias("_known"), F.struct(*order).alias("_place"))
    return links.join(places, (F.col(key) == F.col("_known")) & (F.col("_place") <= F.struct(*order)), "left_anti")


def match_terms(
    articles: DataFrame,
    terms: Sequence[str],
    column: str = "content",
    whole_word: bool = False,
) -> DataFrame:
    """One row per article and configured term found in it: ``id, term_no, term, hits``.

    The list is part of the settings, so it travels inside the expression and the job stays a projection.
    """
    lowered = F.lower(column)
    if whole_word:
        found = [
            F.struct(
                F.lit(i).alias("term_no"),
                F.lit(t).alias("term"),
                F.regexp_count(F.col(column), F.lit(text.any_word_pattern([t]))).alias("hits"),
            )
            for i, t in enumerate(terms)
        ]
        table = F.array(*found)
    else:
        listed = F.array(
            *[F.struct(F.lit(i).alias("term_no"), F.lit(t).alias("term")) for i, t in enumerate(terms)]
        )
        table = F.transform(
            listed,
            lambda s: F.struct(
                s["term_no"].alias("term_no"),
                s["term"].alias("term"),
                F.floor(
                    (F.length("_low") - F.length(F.replace(F.col("_low"), s["term"], F.lit(""))))
                    / F.length(s["term"])
                ).cast("int").alias("hits"),
            ),
        )
    hits = F.filter(table, lambda s: s["hits"] > 0)
    return (
        articles.withColumn("_low", lowered)
        .select("id", F.explode_outer(hits).alias("_hit"))
        .where(F.col("_hit").isNotNull())
        .select("id", "_hit.*")
    )


def match_term_table(articles: DataFrame, terms: DataFrame, column: str = "content", gram: int = 4) -> DataFrame:
    """Which terms of a table occur, in any case, in which articles: ``id, term``.

    Texts and terms meet in an equi-join on words, each term by words that it hangs on (``word_hooks``); what hangs on a
    word of a text is a candidate, and is verified with ``contains`` unless the word itself holds the term. Only texts
    with candidates are fetched for that, each once. The vocabulary of the texts is counted first, so that a phrase
    hangs on its rarest word and one with an unknown word is out at once. What is joined with the texts is staged, so
    its size is known and Spark decides what is broadcast; the plan is the same for any size.
    """
    wanted = wanted_terms(terms)
    found = matched_numbers(articles, wanted, column, gram)
    return found.select("id", F.explode_outer("_nos").alias("no")).join(wanted.select("no", "term"), "no").select("id", "term")


def matched_numbers(articles: DataFrame, wanted: DataFrame, column: str, gram: int = 4) -> DataFrame:
    """``id, _nos``: the numbers of the ``wanted_terms`` in each article, in one row or two per id, no number twice.

    All that hangs on a word travels as one row, and so does all that is found in a text: a pair of text and term is no
    row of its own before the end.
    """
    texts = articles.select("id", F.lower(column).alias("_text"))
    words = texts.select("id", F.explode_outer(F.array_distinct(F.split("_text", " "))).alias("word"))
    vocabulary = stage(words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("texts")), "vocabulary")
    hooks = stage(word_hooks(wanted, vocabulary, gram), "hooks")
    # dealt out by id at once: beforehand the candidates of a text lie with its words, and there is nothing to combine
    met = words.join(hooks, "word").select("id", "sure", "unsure").repartition("id").groupBy("id").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(F.size("sure") > 0, F.col("sure"))))).alias("sure"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.size("unsure") > 0, F.col("unsure"))))).alias("unsure"),
    )
    pairs = stage(met, "pairs")

    found = pairs.where(F.size("sure") > 0).select("id", F.col("sure").alias("_nos"))
    open_ = pairs.where(F.size("unsure") > 0).select("id", F.explode_outer("unsure").alias("no"))
    listed = open_.join(wanted.select("no", "needle"), "no").groupBy("id").agg(
        F.collect_list(F.struct("needle", "no")).alias("_terms")
    )
    held = F.transform(F.filter("_terms", lambda t: F.col("_text").contains(t["needle"])), lambda t: t["no"])
    verified = listed.join(texts, "id").select("id", held.alias("_held")).groupBy("id").agg(
        F.array_distinct(F.flatten(F.collect_list("_held"))).alias("_nos")  # an id may have several texts
    )
    return found.unionByName(verified)


def wanted_terms(terms: DataFrame) -> DataFrame:
    """``term, needle, no``: the distinct terms, in lower case and with a number, written once; empty ones are left out."""
    needles = terms.select("term", F.lower("term").alias("needle")).where(F.length("needle") > 0).distinct()
    return stage(needles.withColumn("no", F.monotonically_increasing_id()), "terms")


def word_hooks(wanted: DataFrame, vocabulary: DataFrame, gram: int) -> DataFrame:
    """``word, sure, unsure``: the words of the texts that terms can only occur with, once each, and the numbers of those
    terms, apart by whether such a word is enough.

    Texts are cut at single spaces. A term with words between two spaces needs each of them: it hangs on the rarest. A
    term with a space, but no word between two, needs a word that begins with what follows its last space, or one that
    ends with what precedes its first; it hangs on those of the longer part. A term without a space is part of a word: it
    hangs on all words that hold it. Beginnings, ends and parts meet the vocabulary by a hash of their first ``gram``
    characters, and are then compared.
    """
    pieces = F.split("needle", " ")
    inner = F.array_distinct(F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: w != ""))
    cut = wanted.select("no", "needle", F.size(pieces).alias("_n"), inner.alias("_inner"), pieces.alias("_pieces"))

    needed = cut.where("size(_inner) > 0").select("no", F.explode_outer("_inner").alias("word"))
    counted = needed.join(vocabulary, "word", "left")
    rarest = counted.groupBy("no").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "word")).alias("_r"))
    phrases = rarest.where("_r.texts > 0").select("_r.word", "no", F.lit(False).alias("sure"))

    first, last = F.col("_pieces")[0], F.element_at("_pieces", -1)
    at_start = F.length(last) >= F.length(first)
    part = F.when(F.col("_n") == 1, F.col("needle")).when(at_start, last).otherwise(first)
    side = F.when(F.col("_n") == 1, "in").when(at_start, "start").otherwise("end")
    sought = cut.where("size(_inner) = 0").select("no", part.alias("part"), side.alias("side")).withColumn(
        "size", F.least(F.length("part"), F.lit(gram))
    )
    # what a word begins or ends with is compared from that side inwards, so both are one look-up
    sought = sought.withColumn(
        "seed", F.when(F.col("side") == "end", F.expr("right(part, size)")).otherwise(F.expr("left(part, size)"))
    )
    kinds = [(r["side"], r["size"]) for r in sought.select("side", "size").distinct().collect()]  # some few at most
    hung = phrases
    if kinds:
        listed = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(n).alias("size")) for side, n in sorted(kinds)])
        word, size, last_place = F.col("word"), F.col("_k.size"), F.length("word") - F.col("_k.size") + 1
        places = (
            F.when(last_place < 1, F.array().cast("array<int>"))
            .when(F.col("_k.side") == "in", F.sequence(F.lit(1), last_place))
            .otherwise(F.array(F.when(F.col("_k.side") == "start", 1).otherwise(last_place)))
        )
        spread = (
            vocabulary.select("word", F.explode_outer(listed).alias("_k"))
            .select("word", "_k", F.explode_outer(places).alias("_at"))
            .where("_at IS NOT NULL")
            .select("word", F.xxhash64("_k.side", F.substr(word, F.col("_at"), size)).alias("_seed"))
        )
        holds = (
            F.when(F.col("side") == "in", word.contains(F.col("part")))
            .when(F.col("side") == "start", word.startswith(F.col("part")))
            .otherwise(word.endswith(F.col("part")))
        )
        keyed = sought.select("no", "part", "side", F.xxhash64("side", "seed").alias("_seed"))
        parts = spread.join(keyed, "_seed").where(holds).select("word", "no", (F.col("side") == "in").alias("sure"))
        hung = phrases.unionByName(parts)
    return hung.groupBy("word").agg(
        F.collect_set(F.when(F.col("sure"), F.col("no"))).alias("sure"),
        F.collect_set(F.when(~F.col("sure"), F.col("no"))).alias("unsure"),
    )


def _ordered(name: str) -> Column:
    return F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc()


def keyword_hits(
    keywords: DataFrame,
    docs: DataFrame,
    per_keyword: int | None = None,
    order: Sequence[str] = (),
    column: str = "title",
) -> DataFrame:
    """The documents for every keyword, the first ``per_keyword`` if set; a document may answer several keywords.

    ``keywords(pos, keyword)``; result ``pos, keyword`` and the document columns. Documents are ranked by the
    ``order`` columns (a leading minus: largest first), then by id, on their ids alone; only the chosen are fetched.
    """
    wanted = wanted_terms(keywords.select(F.col("keyword").alias("term")))
    found = matched_numbers(docs, wanted, column)
    placed = keywords.groupBy("keyword").agg(F.min("pos").alias("pos"))
    named = stage(wanted.select(F.col("no").alias("_no"), F.col("term").alias("keyword")).join(placed, "keyword"), "keywords")
    if per_keyword is None:
        # a document is fetched once for all that is found in it
        met = found.join(docs, "id").select(*docs.columns, F.explode_outer("_nos").alias("_no"))
        return met.join(named, "_no").select("pos", "keyword", *docs.columns)
    hits = found.select("id", F.explode_outer("_nos").alias("_no")).join(named, "_no").select("pos", "keyword", "id")
    if order:
        hits = hits.join(docs.select("id", *[c.lstrip("-") for c in order]), "id")
    best = first_per_group(hits, ["pos", "keyword"], [*[_ordered(c) for c in order], F.col("id")], per_keyword)
    chosen = stage(best.select("pos", "keyword", "id"), "hits")
    return chosen.join(docs, "id").select("pos", "keyword", *docs.columns)


def join_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Attach model output by text fingerprint and rubric fingerprint; requests without output stay."""
    return attach_responses(requests, {"raw": responses})


def attach_responses(requests: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """As ``join_responses``, with the outputs of several tables under their names.

    Both fingerprints are one key here: if one is a constant, Spark would group by the other and deal texts out again to join.
    """
    key = F.concat("content_key", F.lit("\x01"), "rubric_key").alias("_key")
    joined = requests.select("*", key)
    for name, responses in tables.items():
        known = responses.select(key, "raw").groupBy("_key").agg(F.min("raw").alias(name))
        joined = joined.join(known, "_key", "left")
    return joined.select(
        "content_key", "rubric_key", *[c for c in requests.columns if c not in ("content_key", "rubric_key")], *tables
    )


def asked_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The responses to these requests, written once: keys are compared first, so other responses are not moved."""
    keys = ["content_key", "rubric_key"]
    asked = responses.select(*keys).join(requests.select(*keys), keys, "left_semi").distinct()
    return stage(responses.join(stage(asked, "asked"), keys, "left_semi"), "responses")


def fresh_responses(requests: DataFrame, responses: DataFrame, as_of, ttl_seconds: int) -> DataFrame:
    """As ``join_responses``, with responses that carry a time ``answered_at``: the newest one no older than the TTL."""
    moment = dates.as_timestamp(as_of)
    age = F.unix_seconds(moment) - F.unix_seconds("answered_at")
    valid = responses.where((age >= 0) & (age < ttl_seconds))
    known = valid.groupBy("content_key", "rubric_key").agg(F.max(F.struct("answered_at", "raw"))["raw"].alias("raw"))
    return requests.join(known, ["content_key", "rubric_key"], "left")


def best_criteria(
    docs: DataFrame, criteria: DataFrame, k: int = 3, key: str = "id", vector: str = "embedding", block: int = 256
) -> DataFrame:
    """``key, criterion_no, score``: the ``k`` criteria nearest to every document, ties to the smaller number.

    ``criteria(criterion_no, criterion)`` are put into blocks of ``block`` rows, and a document meets a block as one
    row, so a pair is never a row of its own. Norms are computed once for each vector.
    """
    normed = criteria.select(
        F.struct(F.col("criterion_no").alias("no"), F.col("criterion").alias("v"), scoring.norm(F.col("criterion")).alias("n"))
        .alias("c"),
    )
    count = criteria.count()
    blocks = max(1, -(-count // block))
    packed = stage(
        normed.groupBy(F.pmod(F.xxhash64("c.no"), F.lit(blocks)).cast("int").alias("_block"))
        .agg(F.collect_list("c").alias("_criteria")),
        "criteria",
    )
    measured = compute_once(docs.select(key, vector), {"_norm": scoring.norm(F.col(vector))})
    met = measured.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "_block")
    scored = F.transform(
        "_criteria",
        lambda c: F.struct(
            (-scoring.similarity_points(F.col(vector), c["v"], F.col("_norm") * c["n"])).alias("s"), c["no"].alias("no")
        ),
    )
    best = met.select(key, F.explode_outer(F.slice(F.array_sort(scored), 1, k)).alias("_b")).where(F.col("_b").isNotNull())
    named = best.select(key, F.col("_b.no").alias("criterion_no"), (-F.col("_b.s")).alias("score"))
    return first_per_group(named, [key], [F.col("score").desc(), F.col("criterion_no")], k)
