"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.decontamination import decontaminate
from codeloom.llm.embedding_join import near_duplicate_vectors
from codeloom.llm.html_extraction import extract_main_text
from codeloom.llm.jaccard_join import jaccard_components
from codeloom.llm.language_id import fit_language_model, identify_language
from codeloom.llm.line_dedup import dedup_lines
from codeloom.llm.packing import pack_documents
from codeloom.llm.sharding import rendezvous_shard, shard_records
from codeloom.llm.token_counts import count_tokens
from codeloom.llm.token_files import read_token_files, token_digest, write_token_files

N_SHARDS, CAPACITY, TOKEN_LIMIT = 8, 4096, 4096


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves no remainder by 5; null keys are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(~held_out()))
    found = identify_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=CAPACITY)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", cosine=0.95)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return token_digest(read_token_files(spark, path))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), TOKEN_LIMIT)


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    sharded = shard_records(rows, "doc_id", [1.0] * N_SHARDS, tie=["size", "text_crc32"])
    grown = rendezvous_shard(F.col("doc_id"), [1.0] * (N_SHARDS + 1))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text", size=5, percent=80)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_best_fit_packing, op3_embedding_near_dedup, op4_token_files, op5_token_counts, op6_rendezvous_sharding,
    op7_html_extraction, op8_benchmark_decontamination, op9_jaccard_join, op10_line_dedup,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_REACH = """edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
        least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""

ORACLE_SQL: dict[str, str] = {
    "op8_benchmark_decontamination": f"""
        WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS win
            FROM item, unnest(range(greatest(len(w) - 9, 1))) AS u(i) WHERE len(w) > 0),
        doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM win),
        places AS (
            SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win
            FROM doc, sizes, unnest(range(len(w) - n + 1)) AS u(i) WHERE len(w) >= n),
        hit AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN win USING (win)),
        words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(n)) AS u(k) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined
            FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        {_REACH}
        SELECT vec_id, (SELECT count(*) FROM edge WHERE edge.a = vec_id) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
        FROM embeddings LEFT JOIN least_of ON least_of.a = vec_id""",
    "op9_jaccard_join": f"""
        WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sh AS (
            SELECT DISTINCT doc_id AS id, array_to_string(w[i + 1 : i + least(5, len(w))], ' ') AS s
            FROM doc, unnest(range(greatest(len(w) - 4, 1))) AS u(i) WHERE len(w) > 0),
        n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
        met AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
        link AS (SELECT a, b FROM met JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        {_REACH}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
        FROM doc LEFT JOIN n ON n.id = doc_id LEFT JOIN least_of ON least_of.a = doc_id""",
}
