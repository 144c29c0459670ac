"""The registered query of each operator: production parameters, whole tables, digests where the contract asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm import alignment, bpe_automaton, grace_dedup, kneser_ney, langid, line_dedup, media, packing, pivot_index, prefix_trie, simhash, token_counts, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "block_bytes", F.sha2("record", 256).alias("record_sha256")
    )


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_automaton.encode_decode(_documents(spark, sf_dir))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_documents(spark, sf_dir))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.language_model_scores(_documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(_documents(spark, sf_dir)))


def op10_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node")


def op12_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = grace_dedup.exact_duplicates(_documents(spark, sf_dir))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = alignment.align(_documents(spark, sf_dir))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_line_dedup": op4_line_dedup,
    "op5_media_columns": op5_media_columns,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_token_counts": op9_token_counts,
    "op10_pivot_index": op10_pivot_index,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_grace_dedup": op12_grace_dedup,
    "op13_alignment": op13_alignment,
}

#: Lines with their keys, what each key's documents are, and the lines that stay, joined again in order.
LINE_DEDUP_SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), held AS (
    SELECT k, min(doc_id) AS low FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) <> max(doc_id)
), marked AS (
    SELECT keyed.*, held.low IS NOT NULL AND held.low <> doc_id AS gone FROM keyed LEFT JOIN held USING (k)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: All pairs by brute force, then the smallest id that links reach.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(u, v) AS (
    SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), low AS (SELECT u, min(v) AS m FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.m, vec_id)) AS component_id, vec_id <= coalesce(low.m, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.u = vec_id LEFT JOIN n ON n.u = vec_id
"""

#: Rebuilt conversations as lists of digests, all their prefixes, and sums over every prefix of every node. CRC-32 goes bit by bit.
PREFIX_TRIE_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
           len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS turns,
           xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
               lambda a, b: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(a, b)), 4294967295), 4294967295) % 4 AS h
    FROM t GROUP BY conv_id
), s AS (
    SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
    FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20
), p AS (
    SELECT conv_id, d, list_transform(list_slice(turns, 1, d), lambda x: x.d) AS node, CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS words, d = len(turns) AS ends
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM s)
), n AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM p GROUP BY node, d
), k AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1
), u AS (
    SELECT list_slice(node, 1, a) AS node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT n.node, CASE WHEN k.node IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved, unnest(range(d + 1)) AS a FROM n LEFT JOIN k ON k.node = n.node) GROUP BY 1
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN u ON u.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.node = list_slice(n.node, 1, n.d - 1)
"""

#: Groups of equal texts.
EXACT_DUPLICATES_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: XXH64, the tokenizer, compression, WAV features, name-based ids and the packing have no SQL form: those are tested against brute force.
ORACLES: dict[str, str] = {"op4_line_dedup": LINE_DEDUP_SQL, "op10_pivot_index": NEAR_VECTORS_SQL, "op11_prefix_trie": PREFIX_TRIE_SQL, "op12_grace_dedup": EXACT_DUPLICATES_SQL}
