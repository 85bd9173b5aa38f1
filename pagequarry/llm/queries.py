"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.simhash_dedup import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.toxicity import fit, held_out, score

    docs = _table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.phrase_dedup import remove_repeats

    left = remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.pii import BASE, count, find, written

    found = find(_table(spark, sf_dir, "documents"))
    counts = [count("base", k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.line_dedup import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.langid import fit_on_documents, held_out, predict

    docs = _table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit_on_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    from pagequarry.llm.bpe import decode, encode

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, path, pattern or public_tokenizers.PATTERN).select("doc_id", "ids"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.matroska import read_back, store_texts

    back = read_back(store_texts(_table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from pagequarry.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.conversations import damaged, repair

    return repair(damaged(_table(spark, sf_dir, "conversations")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.merkle import fold, manifest, proof

    found = manifest(_table(spark, sf_dir, "documents")).withColumn("folded_root", fold(F.col("altered"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.llm.url_filters import judged

    return judged(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_topk_search": op8_topk_search,
    "op9_matroska": op9_matroska,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filters": op13_url_filters,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), p AS (
            SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
        ), h AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p JOIN d USING (doc_id)
        ), f AS (
            SELECT k, min(doc_id) AS first FROM h GROUP BY k
        ), c AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN f USING (k) WHERE first < doc_id
        ), g AS (
            SELECT doc_id, list(j) AS js, count(*) AS n FROM c GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
            sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE [x FOR x, j IN w IF NOT list_contains(js, j)] END, ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "op8_topk_search": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_conversation_repair": oracle.conversation_repair(),
    "op12_merkle_manifest": oracle.merkle_manifest(),
    "op13_url_filters": oracle.url_filters(),
}
