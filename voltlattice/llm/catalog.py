"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltlattice.llm import (
    conversation_repair, exact_dedup, fingerprints, language_id, line_dedup, minhash_dedup, packing, piece_sampling, quality_rank,
    resampling, token_files, topk_search, warc,
)
from voltlattice.llm.common import crc_fold, prepare, read_table, shared_dir, text_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, kind = shared_dir(spark, "token-files"), token_files.id_kind(49408)
    token_files.write(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 1, kind)
    return token_files.read(spark, folder, kind).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(read_table(spark, sf_dir, "documents"))


@query("op5_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
    d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
    FROM d""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, archives = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    names = warc.write_arc(read_table(spark, sf_dir, "pages"), arc)
    back = warc.read_archives(warc.convert(names, arc, archives), archives, payloads=False)
    return back.select(F.col("key").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").try_cast("long").alias("refers_to"))


@query("op6_minhash_dedup")
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


@query("op7_exact_dedup", r"""
    WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
    FROM n WINDOW w AS (PARTITION BY h)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(language_id.outside_fold()))
    told = language_id.predict_column(spark, model, F.col("text"))
    return docs.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), told.alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op9_piece_sampling")
def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text and what they decode to: the digest of the text itself."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")  # more rows share the lattices of a batch
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = read_table(spark, sf_dir, "documents").select("doc_id", piece_sampling.encode_column(path, "doc_id", text_of()).alias("ids"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
                        F.sha2(piece_sampling.decode_column(path, "ids"), 256).alias("decoded_sha256"))


@query("op10_quality_rank")
def op10_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality_rank.fit(docs, labels, quality_rank.outside_fold())
    scored = docs.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"),
                         quality_rank.score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_rank.ACCEPT).cast("int"))


#: crc32 of a text in SQL: its bytes folded through the table that the polynomial gives.
CRC32_SQL = """
    polynomial AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b,
      list_reduce([CAST(b AS BIGINT)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
    hexed AS (SELECT w, hex(encode(w)) AS h FROM to_hash),
    hashed AS (SELECT w, xor(4294967295, list_reduce([4294967295] || list_transform(range(CAST(length(h) // 2 AS BIGINT)),
      lambda k: CAST(CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS INTEGER) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM hexed, polynomial)"""


@query("op11_importance_resampling", rf"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{resampling.UPPER}', '{resampling.LOWER}'),
        '{resampling.SEPARATORS}'), lambda w: w <> '') AS ws FROM documents),
    b AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{resampling.UPPER}', '{resampling.LOWER}'),
        '{resampling.SEPARATORS}'), lambda w: w <> '') AS ws FROM benchmark),
    raw AS (SELECT r, unnest(ws) AS w FROM d), aim AS (SELECT unnest(ws) AS w FROM b),
    to_hash AS (SELECT w FROM raw UNION SELECT w FROM aim), {CRC32_SQL},
    counts AS (SELECT k, coalesce(max(n) FILTER (side = 0), 0) AS s, coalesce(max(n) FILTER (side = 1), 0) AS t FROM (
      SELECT crc % 10000 AS k, 0 AS side, count(*) AS n FROM raw JOIN hashed USING (w) GROUP BY k
      UNION ALL SELECT crc % 10000 AS k, 1 AS side, count(*) AS n FROM aim JOIN hashed USING (w) GROUP BY k) GROUP BY k),
    gains AS (SELECT k, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM counts),
    means AS (SELECT r, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM raw JOIN hashed USING (w) JOIN gains ON k = crc % 10000 GROUP BY r),
    scored AS (SELECT doc_id, r, CAST(len(ws) AS BIGINT) AS n_features, coalesce(m, 0) AS weight, coalesce(m, 0) + CAST(floor(-1000 * ln(-ln(
      (CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN means USING (r)),
    ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM ranks) // 100 THEN place END AS rank
    FROM scored LEFT JOIN ranks USING (r)""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    return conversation_repair.repair_damaged(read_table(spark, sf_dir, "conversations"))


@query("op13_topk_search", """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM k WHERE place <= 5""")
def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(topk_search.BLOCK_ROWS))
    return topk_search.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
