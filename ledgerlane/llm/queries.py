"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import crc_of_id, table


def op1_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.grid_order_join import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_of_id() % 5 == 0).alias("held_out"))
    return identify(spark, docs.drop("lang"), train(docs.filter("not held_out"))).drop("text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.chat_format import digest

    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    return digest(turns.unionByName(extra))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.multi_index import search

    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.hilbert_shards import shards

    return shards(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.source_mix import mix_plan

    return mix_plan(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from ledgerlane.llm.bpe_automaton import encoded

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, vocabulary or default_vocabulary(), spark).drop("text")


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.ngram_lm import scored, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_of_id() % 5 == 1).alias("held_out"))
    return scored(spark, docs, train(spark, docs.filter("not held_out"), order=3)).drop("text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return mine(spark, rows, F.col("vec_id") % 100 == 0)


def op12_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.line_frequency import verdicts

    return verdicts(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlane.llm.centroid_clusters import clusters

    return clusters(table(spark, sf_dir, "embeddings"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: The results of exact operators do not depend on the method, so plain SQL can state them.
ORACLE = {
    "op1_grid_order_join": """
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.reach = l.x),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x), c AS (SELECT vec_id, min(reach) AS least FROM r GROUP BY vec_id)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.least, t.vec_id) AS component_id, coalesce(c.least, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN n ON t.vec_id = n.vec_id LEFT JOIN c ON t.vec_id = c.vec_id""",
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\\n|]', '', 'g')) + 1 + length('<|im_start|>') + length('<|im_end|>') + 1 + length(text)
    + CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|') THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END AS written
  FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(written) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""",
    "op11_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5""",
    "op12_line_frequency": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, unnest(range(len(w) - 2)) AS i, unnest(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:len(w)])) AS g FROM w WHERE len(w) > 2),
g AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
t AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g) GROUP BY r),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (
  SELECT r, doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM m GROUP BY r),
h AS (SELECT source, count(DISTINCT coalesce(doc_id, -r - 1)) AS docs FROM m GROUP BY source),
f AS (SELECT m.source, plain FROM m JOIN h ON m.source IS NOT DISTINCT FROM h.source GROUP BY m.source, plain, docs
  HAVING count(DISTINCT coalesce(doc_id, -r - 1)) > 10 AND 100 * count(DISTINCT coalesce(doc_id, -r - 1)) > 10 * docs),
x AS (SELECT r, count(*) AS lines, count(f.plain) AS gone, sum(CASE WHEN f.plain IS NULL THEN 0 ELSE words END) AS words
  FROM m LEFT JOIN f ON m.source IS NOT DISTINCT FROM f.source AND m.plain = f.plain GROUP BY r),
c AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(t.n, 0) AS n_repeat_words,
    coalesce(x.lines, 0) AS n_lines, coalesce(x.gone, 0) AS n_lines_removed, CAST(coalesce(x.words, 0) AS BIGINT) AS n_words_removed
  FROM w LEFT JOIN t USING (r) LEFT JOIN u USING (r) LEFT JOIN x USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * (n_words - n_words_removed) < 50 * n_words AS depleted FROM c)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM b""",
    "op13_centroid_clusters": """
WITH q AS (
  SELECT vec_id, row_number() OVER () AS v, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS (SELECT v, unnest(range(64)) AS i, unnest(q) AS x FROM q),
c0 AS (SELECT c, unnest(range(64)) AS i, unnest(q) AS x FROM (SELECT q, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS c FROM q) WHERE c < 16),
a1 AS (SELECT v, arg_min(c, d * 64 + c) AS c FROM (SELECT x.v, k.c, sum((x.x - k.x) * (x.x - k.x)) AS d FROM x JOIN c0 k USING (i) GROUP BY ALL) GROUP BY v),
m1 AS (SELECT c, i, sum(x.x) AS s, count(*) AS n FROM x JOIN a1 USING (v) GROUP BY c, i),
c1 AS (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c0 LEFT JOIN m1 USING (c, i)),
a2 AS (SELECT v, arg_min(c, d * 64 + c) AS c FROM (SELECT x.v, k.c, sum((x.x - k.x) * (x.x - k.x)) AS d FROM x JOIN c1 k USING (i) GROUP BY ALL) GROUP BY v),
m2 AS (SELECT c, i, sum(x.x) AS s, count(*) AS n FROM x JOIN a2 USING (v) GROUP BY c, i),
c2 AS (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c1 LEFT JOIN m2 USING (c, i)),
a3 AS (SELECT v, arg_min(c, d * 64 + c) AS c FROM (SELECT x.v, k.c, sum((x.x - k.x) * (x.x - k.x)) AS d FROM x JOIN c2 k USING (i) GROUP BY ALL) GROUP BY v),
m3 AS (SELECT c, i, sum(x.x) AS s, count(*) AS n FROM x JOIN a3 USING (v) GROUP BY c, i),
c3 AS (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c2 LEFT JOIN m3 USING (c, i)),
e AS (SELECT x.v, k.c, sum((x.x - k.x) * (x.x - k.x)) AS d FROM x JOIN c3 k USING (i) GROUP BY ALL),
n AS (SELECT v, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM e GROUP BY v),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM q JOIN n USING (v) JOIN h ON h.c = n.c""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
