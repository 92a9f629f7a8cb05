"""Registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import decontam, fim, merkle, oracles, packing, pii, png, quality, simhash, token_counts, token_files, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = png.to_media(_table(spark, sf_dir, "documents"))
    media = media.withColumns({"media_bytes": F.length("media").cast("bigint"), "media_sha256": F.sha2("media", 256)})
    s = F.col("samples")
    return png.media_features(media).select(
        "doc_id", "n_bytes", F.length(s).cast("bigint").alias("payload_bytes"), F.sha2(s, 256).alias("payload_sha256"),
        F.crc32(F.substring(s, -32, 32)).cast("bigint").alias("tail_crc32"), "media_bytes", "media_sha256", F.lower(F.hex("feature")).alias("feature"),
    )


def _held(fold: int, out: int):
    return (F.crc32(F.col("doc_id").cast("string")) % fold == out).alias("held_out")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", _held(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("bigint").alias("ids_crc32"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").cast("bigint").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", _held(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.normalize(warc.write(_table(spark, sf_dir, "pages")))
    return warc.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf_hash(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle.build(docs, leaf(F.col("text")), carry=F.nullif(leaf(cut), leaf(F.col("text"))))
    rows = merkle.folded(made.rows, F.coalesce("carry", "leaf"))
    root = F.lit(made.root).cast("string")
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


#: Verdict, host and path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).drop("score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restore(fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c, name: F.sha2(c, 256).alias(name)
    return rows.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest("fim.output", "output_sha256"), digest("text", "restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_pii, op3_decontamination, op4_png, op5_toxicity, op6_token_files, op7_packing, op8_token_counts, op9_quality, op10_warc, op11_merkle, op12_url_filter, op13_fill_in_middle)}
#: The others need a tokenizer, trained models, XXH64 or CRC-32, which SQL lacks. Base32 is written out from the hex digits, five at a time.
ORACLES: dict[str, str] = {
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(floor(CAST('0x' || substr(d.h, 1 + 5 * (i // 4), 5) AS BIGINT) / power(32, 3 - i % 4)) AS BIGINT) % 32, 1)), 'string_agg', '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d JOIN f USING (h)""",
    "op11_merkle": oracles.MERKLE,
    "op12_url_filter": oracles.url_filter(URL_RULES),
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
