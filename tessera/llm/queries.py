"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, digests, language, lines, neighbours, packing, phrases, quality, repair, sharding, simhash, token_counts, warc
from tessera.llm.common import table, written


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 1024)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.through_archives(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), "lang", "source")
    done = sharding.hilbert_shards(written(rows, "metadata"), ["size", "lang", "source"], ["text_crc32", "doc_id"], 24)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests.compared(docs, digests.rarity(docs))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


#: op12_phrases in DuckDB: every phrase counted, then scored and dropped by the contract's rules.
OP12_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?
-]')) AS p FROM docs),
words AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM pieces),
grams AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
heavy AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, a, unnest([g[1] || ' ' || g[2], g[2] || ' ' || g[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN heavy h ON c.k = 2 AND c.lang = h.lang AND c.phrase = h.phrase WHERE h.m IS NULL OR 100 * h.m < 50 * c.a),
cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, g FROM kept),
scored AS (SELECT x.lang, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score FROM cuts x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.g[1 : x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.g[x.cut + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT p.lang, p.rank, p.phrase, p.a, p.l, p.r, total.n, p.score FROM placed p JOIN total USING (lang) WHERE rank <= 2000
"""


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def queries() -> dict:
    import corpus_pipeline

    own = {f.__name__: f for f in (op1_bpe, op2_token_counts, op3_line_dedup, op4_language_id, op5_simhash, op6_warc, op7_nearest, op8_hilbert_shards, op9_quality, op10_packing, op11_fingerprints, op12_phrases, op13_repair)}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are tested against brute force in tests/llm."""
    return {"op12_phrases": OP12_SQL}
