"""Registered queries of the subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.content_sort import exact_duplicates
from ledgerloom.llm.cotraining import quality
from ledgerloom.llm.hypergeometric import shuffle_into_shards
from ledgerloom.llm.language_codes import languages
from ledgerloom.llm.mixing import mixed
from ledgerloom.llm.near_copies import near_duplicates
from ledgerloom.llm.pieces import encode
from ledgerloom.llm.ppm import language_model_scores
from ledgerloom.llm.prefix_trie import prefix_trie
from ledgerloom.llm.shared import documents, prepared, text_crc32, text_or_empty
from ledgerloom.llm.token_lengths import length_histogram, with_token_count
from ledgerloom.llm.toxicity import toxicity
from ledgerloom.llm.treap_search import lexical_topk
from ledgerloom.llm.vector_search import exact_topk


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository, beside the entry file

    return corpus_pipeline.run(spark, sf_dir)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return toxicity(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = shuffle_into_shards(documents(spark, sf_dir), shards=8)
    text = text_or_empty()
    return shuffled.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        text_crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return language_model_scores(documents(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return length_histogram(with_token_count(documents(spark, sf_dir).select("text")).select("n_tokens"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="largest")


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return encode(documents(spark, sf_dir))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return languages(spark, documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return lexical_topk(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_exact_search": op8_exact_search,
    "op9_quality": op9_quality,
    "op10_piece_encoding": op10_piece_encoding,
    "op11_language_id": op11_language_id,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_mixing": r"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, source, coalesce(text, '') AS text,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents
        ), keyed AS (
            SELECT doc_id, source, size,
                   floor((1 - pow((('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || text), 1, 13))::BIGINT + 0.5)
                                  / 4503599627370496.0::DOUBLE,
                                  1 / CASE WHEN length(text) / greatest(len(string_split(text, ' ')), 1) BETWEEN 4 AND 11
                                           THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END))
                         * 4503599627370496.0::DOUBLE)::BIGINT AS k
            FROM doc
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
            FROM keyed GROUP BY source
        ), levels AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap,
                   (1.5::DOUBLE * sum(source_size) OVER ()
                    - coalesce(sum(2.0::DOUBLE * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
                   row_number() OVER r AS place
            FROM sources WINDOW r AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)
        ), found AS (
            SELECT arg_min(level, place) AS level FROM levels WHERE level <= cap / weight
        ), targets AS (
            SELECT l.source, source_size, least(cap, coalesce(weight * f.level, cap)) AS target FROM levels l, found f
        ), limits AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets
        ), sums AS (
            SELECT d.source, k, sum(size) AS s, count(*) AS n FROM keyed d GROUP BY d.source, k
        ), running AS (
            SELECT l.source, k, s, n, target - epochs * source_size AS rest,
                   sum(s) OVER (PARTITION BY l.source ORDER BY k) AS upto
            FROM sums JOIN limits l ON sums.source IS NOT DISTINCT FROM l.source
        ), ends AS (
            SELECT source, k AS last_key, greatest(0, ceil((rest - upto + s) * n / s - 0.5)) AS wanted FROM running
            WHERE upto > rest AND upto - s <= rest
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY source, k) AS copy FROM keyed
        )
        SELECT d.doc_id, d.size, l.source_size, l.target,
               (d.size * (l.epochs + CASE WHEN d.k < e.last_key OR d.k = e.last_key AND d.copy <= e.wanted THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM ranked d JOIN limits l ON d.source IS NOT DISTINCT FROM l.source
        LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source
    """,
    "op8_exact_search": """
        WITH codes AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS codes FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.codes::DOUBLE[], c.codes::DOUBLE[])::BIGINT AS score
            FROM codes q JOIN codes c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_prefix_trie": """
        WITH told AS (
            SELECT conv_id, coalesce(role, '') AS role, md5(coalesce(text, '')) AS digest,
                   length(coalesce(text, ''))::BIGINT AS size,
                   row_number() OVER (PARTITION BY conv_id
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), crc_step AS (
            SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, x: CASE WHEN c % 2 = 1
                   THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)
        ), crc_table AS (
            SELECT list(v ORDER BY i) AS t FROM crc_step
        ), conv AS (
            SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(list_prepend(4294967295::BIGINT,
                       list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 6 AS h
            FROM told, crc_table
        ), lent AS (
            SELECT c.conv_id, t.pos AS d, role, digest, size FROM conv c JOIN told t ON t.conv_id = c.base AND t.pos <= c.h
        ), n_lent AS (
            SELECT conv_id, count(*) AS n FROM lent GROUP BY conv_id
        ), made AS (
            SELECT * FROM lent UNION ALL
            SELECT c.conv_id, coalesce(n.n, 0) + t.pos - c.h AS d, role, digest, size
            FROM conv c JOIN told t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN n_lent n ON n.conv_id = c.conv_id
        ), path AS (
            SELECT conv_id, d, size, md5(string_agg(md5(md5(role) || digest), '') OVER (PARTITION BY conv_id ORDER BY d)) AS node
            FROM made UNION ALL SELECT conv_id, 0, 0, '' FROM conv
        ), step AS (
            SELECT *, lag(node) OVER w AS parent, lead(d) OVER w IS NULL AS is_last,
                   min(conv_id) OVER (PARTITION BY node) AS least, count(*) OVER (PARTITION BY node) AS n
            FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY d)
        ), child AS (
            SELECT parent AS node, count(DISTINCT node) AS n_children FROM step WHERE parent IS NOT NULL GROUP BY parent
        ), final AS (
            SELECT s.conv_id, s.node, c.node IS NULL AS childless FROM step s LEFT JOIN child c USING (node) WHERE is_last
        ), ends AS (
            SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM final GROUP BY node
        ), whole AS (
            SELECT s.*, sum(CASE WHEN s.conv_id = least THEN (n - 1) * size ELSE 0 END) OVER (PARTITION BY s.conv_id ORDER BY d DESC) AS saved,
                   CASE WHEN f.childless THEN f.node END AS leaf
            FROM step s JOIN final f USING (conv_id)
        ), node AS (
            SELECT node, min(conv_id) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs,
                   count(DISTINCT leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
            FROM whole GROUP BY node
        )
        SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs,
               coalesce(c.n_children, 0)::BIGINT AS n_children, a.n_leaves, a.saved_tokens,
               coalesce(e.ends_sha256, sha256('')) AS ends_sha256
        FROM node a LEFT JOIN node p ON p.node = a.parent LEFT JOIN child c ON c.node = a.node LEFT JOIN ends e ON e.node = a.node
    """,
    "op13_lexical_search": r"""
        WITH split AS (
            SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), item AS (
            SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark
        ), words AS (
            SELECT d, doc_id, unnest(terms) AS term FROM split
        ), posting AS (
            SELECT d, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY d, term
        ), doc AS (
            SELECT d, sum(tf)::BIGINT AS n FROM posting GROUP BY d
        ), total AS (
            SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM doc
        ), weight AS (
            SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM posting, total GROUP BY term
        ), asked AS (
            SELECT i, any_value(item_id) AS item_id, term, count(*) AS n FROM (SELECT i, item_id, unnest(terms) AS term FROM item)
            GROUP BY i, term
        ), scored AS (
            SELECT a.i, any_value(a.item_id) AS item_id, p.d, any_value(p.doc_id) AS doc_id,
                   sum(a.n * w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * doc.n * n_docs) // n_terms))))::BIGINT AS score
            FROM asked a JOIN posting p USING (term) JOIN weight USING (term) JOIN doc ON doc.d = p.d, total GROUP BY a.i, p.d
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
}
