"""One thin query for each operator, over its whole table, in the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm import ann, bpe, jaccard, langid, packing, periodic, quality, rules, sharding, tokenfiles, urls, vectorcodes, warc
from readweave.session import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode with the byte-level vocabulary."""
    out = bpe.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn languages outside the held-out fold, then predict every document's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~quality.held_out("doc_id")))
    out = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.withColumn("held_out", quality.held_out("doc_id"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn quality from labels outside the held-out fold, then score every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).withColumn("held_out", quality.held_out("doc_id"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and classifier over every URL."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their five-word shingles."""
    return jaccard.components(table(spark, sf_dir, "documents"), width=5, percent=75)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write token files in ascending doc_id order and read them back."""
    folder = new_folder(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfiles.with_crc32(tokenfiles.read(spark, folder))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack documents into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the rules."""
    return rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives and read them back."""
    folder = new_folder(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), folder, least=1000)
    return warc.read(spark, folder, payloads=False).select(
        F.col("key").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to"
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 16 parts, 64 entries each, after two rounds."""
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the words of one document in ten repeat from a place on, both by its number's hash."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    begun = cut.withColumn("a", F.expr("cast(if(size(w) > 0, g % size(w), null) as int)"))
    period = begun.withColumn("p", F.expr("cast(1 + floor((size(w) - a) / (3 + g % 8)) as int)"))
    again = F.expr("array_join(transform(sequence(0, size(w) - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' ')")
    return period.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(again).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least six words and four periods, and the texts that are left without their repeats."""
    return periodic.runs(repeating(table(spark, sf_dir, "documents")), least=6, powers=4).drop("n_words")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes; equal texts keep together."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_bpe, op2_language_id, op3_quality, op4_url_filter, op5_jaccard_join, op6_token_files, op7_packing, op8_nearest,
            op9_quality_rules, op10_warc, op11_vector_codes, op12_periodic_runs, op13_sharding
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": jaccard.oracle(), "op9_quality_rules": rules.oracle(), "op10_warc": warc.oracle(), "op11_vector_codes": vectorcodes.oracle()}
