"""The corpus operators as queries over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    chat, clustering, jaccard, packing, quality, resample, secrets, sentencepiece_codec, sharding, token_counts, topk,
    toxicity, vptree,
)
from newsloom.llm.common import table
from newsloom.session import new_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded with a public model, decoded again and compared with the library's own ids."""
    return sentencepiece_codec.encode_texts(table(spark, sf, "documents"), keep_ids=False)


@query
def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 24 shards that each hold the mixture of sources; the counts differ by one at most."""
    placed = sharding.interleave(table(spark, sf, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source", "fraction",
    )


@query
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals after three batches over all documents, the second of them delivered twice.

    Batch 1 inserts every document; batch 2 deletes the later copies of equal texts; batch 3 revises what is left of
    the languages other than English, now counted with the vocabulary for many languages.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    first, later = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
    # Each text is counted where it is read, with both vocabularies if it may be revised; only counts and digests move.
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    versions = F.when(F.col("lang") != "en", F.array(F.lit(first), F.lit(later))).otherwise(F.array(F.lit(first)))
    counts = stage(
        token_counts.count_tokens(docs.withColumn("digest", digest).withColumn("tokenizer_version", F.explode(versions))),
        "counts",
    )
    inserts = counts.filter(F.col("tokenizer_version") == first)
    firsts = inserts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = inserts.join(firsts, "digest").filter("doc_id > first").select("doc_id", "lang", "source", "tokenizer_version")

    def changes(rows: DataFrame, batch: int, op: str) -> DataFrame:
        return rows.withColumn("seq", F.lit(batch).cast("long")).withColumn("op", F.lit(op))

    rollup = token_counts.TokenRollup(spark, new_folder(spark, "token-counts"))
    rollup.commit(1, changes(inserts, 1, "insert"))
    deletes = changes(copies.withColumn("tokens", F.lit(0).cast("long")), 2, "delete")
    rollup.commit(2, deletes)
    rollup.commit(2, deletes)
    present = rollup.states().filter("present").select("doc_id")
    revised = counts.filter(F.col("tokenizer_version") == later).join(present, "doc_id", "left_semi")
    rollup.commit(3, changes(revised, 3, "revise"))
    return rollup.totals()


@query
def op4_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    template = chat.Template()
    formatted = chat.format_chats(turns, template)
    back = formatted.withColumn("_back", chat.read_turns(F.col("formatted"), template)).withColumn(
        "_loss", chat.loss_text(F.col("segments"), template)
    )
    said = F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "invalid_turn",
        "complete",
    )


@query
def op5_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


@query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's toxicity; the fifth held out by id teaches nothing."""
    scored = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", (toxicity.part_of() == 0).alias("held_out"), "score", "predicted")


@query
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict for every document; documents labelled good are the trusted texts."""
    docs = table(spark, sf, "documents")
    return quality.quality_rules(docs, quality.trusted_texts(docs, table(spark, sf, "labels")))


@query
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return packing.pack_documents(table(spark, sf, "documents"))


@query
def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Documents linked by a word-shingle similarity of 0.9 or more, as components."""
    return jaccard.jaccard_components(table(spark, sf, "documents"))


@query
def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document, with the weak parts that complete a credential."""
    return secrets.digest(secrets.find_secrets(table(spark, sf, "documents")))


@query
def op11_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors in eight clusters after ten rounds."""
    found = clustering.centroid_clusters(table(spark, sf, "embeddings"))
    assigned = stage(found.assigned, "assigned")
    of_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    sums = {row["cluster"]: int(row["sum"]) for row in of_cluster.collect()}  # a row for each cluster
    largest = clustering.LARGEST
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    clusters = spark.createDataFrame(
        [(i, min(sums.get(i, 0), largest), min(sum(sums.values()), largest), name) for i, name in enumerate(names)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


@query
def op12_simhash_components(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose fingerprints differ in two bits at most, as components."""
    return vptree.simhash_components(table(spark, sf, "documents"))


@query
def op13_importance_resample(spark: SparkSession, sf: str) -> DataFrame:
    """A twentieth of all documents of twenty words or more, drawn towards the benchmark's n-grams."""
    drawn = resample.importance_resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op2_sharding"] = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, coalesce('=' || source, '-') AS stratum FROM documents),
h AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '17', doc_id::VARCHAR, md5(t))), 1, 15))::BIGINT AS h FROM d),
f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) - 0.5::DOUBLE)
             / count(*) OVER (PARTITION BY stratum) AS fraction FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, h, doc_id) - 1 AS pos, count(*) OVER () AS n FROM f),
b AS (SELECT doc_id, hex(encode(t)) AS x FROM d),
c AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1, 2),
        lambda i: ('0x' || x[i:i+1])::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda r, z: xor(r >> 1, (r & 1) * 3988292384))) AS crc FROM b)
SELECT p.doc_id, strlen(t) + 8 AS size, xor(crc, 4294967295) AS text_crc32, 'rows' AS law,
       (pos * 24 // n)::INT AS shard, pos - ((pos * 24 // n) * n + 23) // 24 AS slot, NULL::INT AS grown_shard,
       source, fraction
FROM p JOIN c USING (doc_id)"""

ORACLES["op4_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last FROM t),
s AS (SELECT *, length(regexp_replace(text, '([<\[\\])', '\1\\', 'g'))
             + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
               ELSE 20 + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) END AS chars,
             NOT coalesce(CASE WHEN pos = 0 THEN role IN ('system', 'user') WHEN last = 'system' THEN role = 'user' AND pos = 1
               WHEN last = 'user' THEN role = 'assistant' WHEN last = 'assistant' THEN role = 'user' END, false) AS wrong
      FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, (min(pos) FILTER (wrong))::INT AS invalid_turn,
       min(pos) FILTER (wrong) IS NULL AND max_by(role, pos) = 'assistant' AS complete
FROM s GROUP BY conv_id"""

ORACLES["op5_topk_search"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)),
             lambda i: array_to_string(w[i:i+2], ' '))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM s GROUP BY list_sort(s), len(s)),
e AS (SELECT id, n, unnest(s) AS g FROM c),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
o AS (SELECT id, n, g, row_number() OVER (PARTITION BY id ORDER BY df, g) AS pos FROM e JOIN f USING (g)),
p AS (SELECT * FROM o WHERE pos <= n - (90 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.g = b.g AND a.id < b.id
          AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM pairs JOIN c x ON x.id = a JOIN c y ON y.id = b
      WHERE 190 * len(list_intersect(x.s, y.s)) >= 90 * (x.n + y.n)),
near AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, root) AS (SELECT id, id FROM c UNION SELECT near.b, root FROM reach JOIN near ON near.a = id),
r AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT documents.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(r.root, documents.doc_id) AS component_id
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.s = list_sort(s.s) LEFT JOIN r ON r.id = c.id"""


def _clusters_sql(rounds: int = 10) -> str:
    """Each round's distances, assignment and centroids as tables of their own; floor(sum / count) of whole numbers."""
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: "
        "floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND "
        "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), e) - 1 AS c, e AS m FROM v "
        "WHERE vec_id IS NOT NULL QUALIFY c < 8)",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT i, arg_min((c, d), (d, c)) AS best FROM (SELECT v.i, c, list_sum(list_transform("
            f"list_zip(v.e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY i)"
        )
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT best[1] AS c, pos, sum(e[pos])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (i), "
                f"range(1, 65) t(pos) GROUP BY ALL),\n"
                f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(list((s - ((s % n) + n) % n) // n ORDER BY pos) FILTER (n > 0), "
                f"any_value(m)) AS m FROM c{r} LEFT JOIN s{r} USING (c) GROUP BY c)"
            )
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, best[1]::INT AS cluster, best[2] AS distance, (sum(best[2]) OVER (PARTITION BY best[1]))::BIGINT AS cluster_inertia,
       (sum(best[2]) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (i) JOIN c{rounds} ON c = best[1]"""
    )


ORACLES["op11_centroid_clusters"] = _clusters_sql()

ORACLES["op13_importance_resample"] = r"""
WITH tab AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384)) ORDER BY i) AS t
         FROM range(256) x(i)),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS i, 'd' AS side, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER (), 't', NULL, text FROM benchmark),
w AS MATERIALIZED (
  SELECT i, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM d),
g AS (SELECT i, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]),
         list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]))) AS g FROM w),
n AS MATERIALIZED (SELECT i, side, g, count(*) AS n FROM g GROUP BY ALL),
x AS MATERIALIZED (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM n)),
b AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1, 2),
         lambda k: ('0x' || x[k:k+1])::BIGINT)), lambda crc, byte: xor(crc >> 8, t[(xor(crc, byte) & 255) + 1])),
         4294967295) % 10000 AS b FROM x, tab),
s AS (SELECT b, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 't'), 0)::BIGINT AS t
      FROM n JOIN b USING (g) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
              / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM s),
weight AS (SELECT i, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
           FROM n JOIN b USING (g) JOIN gain USING (b) WHERE side = 'd' GROUP BY i),
r AS (SELECT w.i, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                 + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN weight USING (i) WHERE side = 'd'),
o AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (i)"""
