"""The corpus operators as named queries over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import table


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(sh) AS x FROM s),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM i JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * c >= 80 * (p.n_shingles + q.n_shingles - c)),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, coalesce(min(r.v), n.doc_id)) AS component_id,
  n.doc_id = least(n.doc_id, coalesce(min(r.v), n.doc_id)) AS kept
FROM n LEFT JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.languages import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.chats import format_chats, read_back, streamed

    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return read_back(format_chats(streamed(turns)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.packing import best_fit, byte_lengths

    return best_fit(byte_lengths(table(spark, sf_dir, "documents")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.common import scratch_path
    from roadlens.llm.token_files import read, write

    path = scratch_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path)
    return read(spark, path)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.pieces import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.neighbours import nearest

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?turn>|### ')) AS text_chars,
    length(role) + len(regexp_extract_all(role, '\\|</?turn>|### |:|\n')) AS role_chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn>### ') + role_chars + 2 + text_chars + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

OP9_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT k, vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.k AS u, b.k AS w, b.vec_id AS id FROM g a JOIN g b ON a.k <> b.k WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(u, w, id) AS (SELECT u, w, id FROM l UNION SELECT r.u, l.w, l.id FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, count(*) AS n FROM l GROUP BY u), m AS (SELECT u, min(id) AS m FROM r GROUP BY u)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, CASE WHEN v.vec_id IS NOT NULL THEN least(v.vec_id, coalesce(m.m, v.vec_id)) END AS component_id,
  coalesce(v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)), false) AS kept
FROM v LEFT JOIN c ON c.u = v.k LEFT JOIN m ON m.u = v.k
"""

QUERIES = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_language_id": op2_language_id,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_token_files": op4_token_files,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_secret_scan": op6_secret_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}
ORACLES = {"op1_minhash_forest": OP1_SQL, "op3_chat_formatting": OP3_SQL, "op9_embedding_dedup": OP9_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
