"""One query per operator, over whole tables with production parameters, and SQL twins."""

from pyspark.sql import functions as F

from voxstars.llm import (
    decontamination,
    extraction,
    mixing,
    ppm,
    repeats,
    resampling,
    sharding,
    simhash,
    spelling,
    toxicity,
    vectors,
    warc,
    whitening,
)


def _read(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_benchmark_passages(spark, folder):
    found = decontamination.matches(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.count(F.lit(1)).alias("n_passages"),
        F.min("distance").alias("least_distance"),
        F.max("distance").alias("most_distance"),
    )


def op2_warc_revisits(spark, folder):
    read = warc.deduplicate(_read(spark, folder, "pages"), spark)
    columns = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    return read.select(F.col("record_id").alias("page_id"), *columns)


def op3_repeated_bytes(spark, folder):
    return repeats.remove_repeats(_read(spark, folder, "documents"))


def op4_simhash_components(spark, folder):
    found = simhash.near_duplicates(_read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_ppm_scores(spark, folder):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return ppm.score(_read(spark, folder, "documents"), F.coalesce(held_out, F.lit(False)))


def op6_resample_quality(spark, folder):
    kept = resampling.resample(_read(spark, folder, "documents"), _read(spark, folder, "labels"))
    return kept.select("doc_id", "log_weight", "sample_key")


def op8_toxic_passages(spark, folder):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = _read(spark, folder, "labels").filter(fold != 1)
    scored = toxicity.score(_read(spark, folder, "documents"), labels)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "segments")


def op7_mix_sources(spark, folder):
    docs = _read(spark, folder, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_nearest_vectors(spark, folder):
    return vectors.nearest(_read(spark, folder, "embeddings"), F.expr("vec_id % 50 = 0"))


def op10_main_text(spark, folder):
    pages = _read(spark, folder, "pages").select("page_id", "url", "html")
    texts = pages.select("page_id", "url", extraction.main_text(pages).alias("text"))
    return texts.select("*", F.length("text").cast("long").alias("n_chars"))


def op11_spelling_variants(spark, folder):
    return spelling.group_spellings(_read(spark, folder, "documents"))


def op12_whitened_vectors(spark, folder):
    return whitening.whiten(_read(spark, folder, "embeddings"))


def op13_packed_shards(spark, folder):
    placed = sharding.assign(_read(spark, folder, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {
    "op1_benchmark_passages": op1_benchmark_passages,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_simhash_components": op4_simhash_components,
    "op5_ppm_scores": op5_ppm_scores,
    "op6_resample_quality": op6_resample_quality,
    "op8_toxic_passages": op8_toxic_passages,
    "op7_mix_sources": op7_mix_sources,
    "op9_nearest_vectors": op9_nearest_vectors,
    "op10_main_text": op10_main_text,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitened_vectors": op12_whitened_vectors,
    "op13_packed_shards": op13_packed_shards,
}

ORACLE = {
    "op2_warc_revisits": """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body FROM pages
), h AS (
    SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hexed, min(page_id) OVER (PARTITION BY body) AS first_id FROM p
)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        (CAST('0x' || substr(hexed, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), 'string_agg', '')
        AS payload_digest,
    CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM h""",
    "op9_nearest_vectors": """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
