"""One query per operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from orbloom.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbloom.llm import language_id

    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    import public_tokenizers

    from orbloom.llm import sentencepiece_codec

    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbloom.llm import html_text

    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbloom.llm import jaccard_join

    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbloom.llm import media

    return media.store(_table(spark, sf_dir, "documents"))


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, among all others."""
    from orbloom.llm import permutation_index

    vectors = permutation_index.usable(_table(spark, sf_dir, "embeddings"))
    return permutation_index.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbloom.llm import substring_dedup

    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbloom.llm import suffix_array_dedup

    return suffix_array_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, paired with their neighbours; spans are given as text."""
    from orbloom.llm import preferences

    out = preferences.format_pairs(preferences.neighbour_pairs(_table(spark, sf_dir, "conversations")))

    def shown(c: str):
        return F.array_join(F.transform(F.col(c), lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)

    return out.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", shown("chosen_spans"), shown("rejected_spans"))


def op11_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from them; ``fault`` is null where all checks hold."""
    from orbloom.llm import warc

    return warc.archived(_table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbloom.llm import vector_codes

    return vector_codes.report(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbloom.llm import merkle

    return merkle.manifest(_table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH m AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, role, text) AS ms
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id,
         coalesce(any_value(ms) FILTER (WHERE conv_id % 2 = 0), []) AS c,
         coalesce(any_value(ms) FILTER (WHERE conv_id % 2 = 1), []) AS r
  FROM m GROUP BY 1),
n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1,
                     least(len(c), len(r))) AS n FROM p),
t AS (
  SELECT pair_id, n, c[1:n] AS pc, c[n+1:] AS cc, r[n+1:] AS rc FROM n),
s AS (
  SELECT *,
    list_transform(range(1, len(cc) + 1), lambda i: {'role': cc[i].role, 'b': coalesce(list_sum(list_transform(cc[1:i-1], lambda m: length(m.role) + length(m.text) + 13)), 0)::BIGINT + 5 + length(cc[i].role), 'e': list_sum(list_transform(cc[1:i], lambda m: length(m.role) + length(m.text) + 13))::BIGINT}) AS cs,
    list_transform(range(1, len(rc) + 1), lambda i: {'role': rc[i].role, 'b': coalesce(list_sum(list_transform(rc[1:i-1], lambda m: length(m.role) + length(m.text) + 13)), 0)::BIGINT + 5 + length(rc[i].role), 'e': list_sum(list_transform(rc[1:i], lambda m: length(m.role) + length(m.text) + 13))::BIGINT}) AS rs
  FROM t)
SELECT pair_id, CAST(n AS INTEGER) AS prompt_turns,
  coalesce(array_to_string(list_transform(pc, lambda m: '<|' || m.role || '|>' || chr(10) || m.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(cc, lambda m: '<|' || m.role || '|>' || chr(10) || m.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(rc, lambda m: '<|' || m.role || '|>' || chr(10) || m.text || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(cs, lambda m: m.role = 'assistant'), lambda m: m.b || '-' || m.e), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(list_filter(rs, lambda m: m.role = 'assistant'), lambda m: m.b || '-' || m.e), ','), '') AS rejected_spans
FROM s
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_permutation_index, op2_substring_dedup, op3_suffix_array_dedup, op4_preference_formatting, op5_sentencepiece, op6_best_fit_packing, op7_html_extraction, op8_language_id, op9_ngram_jaccard_join, op10_media_columns, op11_warc_reader, op12_vector_codes, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    from orbloom.llm import oracles

    words = {"op2_substring_dedup": oracles.OP2_SQL, "op3_suffix_array_dedup": oracles.OP3_SQL, "op9_ngram_jaccard_join": oracles.OP9_SQL}
    return words | {"op4_preference_formatting": OP4_SQL, "op11_warc_reader": oracles.OP11_SQL, "op12_vector_codes": oracles.OP12_SQL, "op13_merkle_manifest": oracles.OP13_SQL}
