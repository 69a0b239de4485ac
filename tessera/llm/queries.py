"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe_codec import bpe_codec
from tessera.llm.filter_audit import audit
from tessera.llm.media import media
from tessera.llm.near_dups import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.pii import with_surrogates
from tessera.llm.quality import SPACES, quality
from tessera.llm.repeats import drop_repeats
from tessera.llm.sharding import shard
from tessera.llm.token_counts import token_counts
from tessera.llm.vector_codes import vector_codes
from tessera.llm.vector_links import vector_links
from tessera.llm.wavelet import read_shards, write_shards

#: The registered query's key; a deployment passes its own secret.
PII_KEY = "registered query"
#: Words of a passage that may not repeat.
PASSAGE = 51
#: Percent of distinct words below which a text is one of its language's poor ones.
POOR = 55
WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path(WORDS))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec(_documents(spark, sf_dir), public_tokenizers.path(WORDS), keep=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir)).drop("host_rate")


def hosts_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over hosts that differ: a language's texts of few distinct words are a host of their own, most of which fail, so such hosts go with all their documents."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), f"[{SPACES}]+", -1), lambda w: w != "")
    host = F.concat_ws(":", "lang", F.when(F.size(F.array_distinct(words)) * 100 < F.size(words) * POOR, "poor"))
    return quality(_documents(spark, sf_dir).withColumn("host", host), host_col="host").drop("host_rate")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(_documents(spark, sf_dir), PII_KEY).select("doc_id", "text", "n_entities")


def op5_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(_documents(spark, sf_dir), public_tokenizers.path(WORDS)), keep=False)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir)).drop("_node")


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns follow the law of 400 bytes; `text` is what stays once repeated runs of over 50 words are cut too."""
    out = drop_repeats(_documents(spark, sf_dir), words=PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path(BYTES), keep=False)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(_documents(spark, sf_dir), keep=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds one after the other; distances are sums of whole numbers below 2**53, which doubles hold."""
    out = """WITH kept AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, k, list_transform(v[k * (len(v) // 4) + 1:(k + 1) * (len(v) // 4)], lambda x: floor(1024 * x)) AS v FROM kept, range(4) r(k)),
b0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < 256)"""
    near = "(SELECT p.vec_id, p.label, p.k, any_value(p.v) AS v, min((list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v))::HUGEINT * 256 + b.e) AS best FROM p JOIN b{i} b USING (k) GROUP BY 1, 2, 3)"
    for i in range(rounds):
        out += f""",
a{i} AS {near.format(i=i)},
s{i} AS (SELECT k, e, list(m ORDER BY pos) AS v FROM (SELECT k, best % 256 AS e, pos, floor(sum(v[pos]) / count(*)) AS m FROM a{i}, range(1, 1 + (SELECT max(len(v)) FROM p)) r(pos) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{i + 1} AS (SELECT k, e, coalesce(s.v, b.v) AS v FROM b{i} b LEFT JOIN s{i} s USING (k, e))"""
    return out + f""",
a AS {near.format(i=rounds)},
c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', (best % 256)::BIGINT), '' ORDER BY k) AS code, sum(best // 256)::BIGINT AS error FROM a GROUP BY 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY k, e)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe_codec, op3_quality_rules, op4_pii_surrogates, op5_wavelet_matrix, op6_near_duplicates, op7_suffix_arrays, op8_sharding, op9_packing, op10_media_columns, op11_filter_audit, op12_vector_codes, op13_vector_links, hosts_rejected)}
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 5) r(k) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
base AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE base_failed) AS failures FROM judged GROUP BY 1),
prior AS (SELECT avg(failures / docs) AS m, coalesce(var_samp(failures / docs), 0) AS v FROM hosts),
strong AS (SELECT m, greatest(1, least(1000, coalesce(m * (1 - m) / nullif(v, 0) - 1, 1000))) AS k FROM prior),
rated AS (SELECT source, (failures + m * k) / (docs + k) AS rate FROM hosts, strong)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.6 AS kept FROM judged JOIN rated ON judged.source IS NOT DISTINCT FROM rated.source""",
    "op11_filter_audit": r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, v)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS bits FROM f a, f b, f c, f d, f e WHERE (a.v | b.v | c.v | d.v | e.v) = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS gone FROM o, range(1, 6) r(step))
SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, coalesce(sum(n) FILTER (mask & (own | gone) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & gone = 0 AND mask & own <> 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & gone <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & gone = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER (mask & gone = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost, coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step, own, gone""",
    "op12_vector_codes": _codes_sql(),
    "op13_vector_links": """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
links AS (SELECT a.r AS a, b.r AS b, b.vec_id FROM v a, v b WHERE a.r <> b.r AND a.e IS NOT NULL AND b.e IS NOT NULL AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a, min(v.vec_id) AS vec_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(least.vec_id, v.vec_id)) AS component_id, least(v.vec_id, coalesce(least.vec_id, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN least ON least.a = v.r""",
}
ORACLE_SQL["hosts_rejected"] = ORACLE_SQL["op3_quality_rules"].replace(
    "SELECT doc_id, source, coalesce(text, '') AS t",
    f"SELECT doc_id, concat_ws(':', lang, CASE WHEN len(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) * 100 < len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) * {POOR} THEN 'poor' END) AS source, coalesce(text, '') AS t",
    1,
)
