"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, decontam, fingerprints, jaccard, langid, mixing, quality, rules, sharding, signatures, substring, urls, warc

#: (verdict, host, path) of the URL rules (fixed by the contract).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_remove_repeats(spark, sf_dir):
    """Every document without the words of 50-word windows that also start in an earlier document."""
    rows = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_mix_sources(spark, sf_dir):
    """All documents mixed to 150% of their words with weights 3, 1, 2, at most twice each source."""
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_shard_slots(spark, sf_dir):
    """All documents in 24 shards of near equal bytes through 4,096 virtual slots."""
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))


def op4_fingerprint_chunks(spark, sf_dir):
    """Chunk fingerprints of every document and its edited text, and their likeness."""
    return fingerprints.edited_likeness(_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    """The language of every document by models of the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    return langid.predict(docs, langid.train(docs.where("not held_out")), keep=("doc_id", "held_out"))


def op6_judge_urls(spark, sf_dir):
    """The deciding rule and verdict of every page's URL."""
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op7_resolve_revisits(spark, sf_dir):
    """Every revisit of the pages' crawl log with the response it stands for; headers as lines."""
    rows = warc.resolve_revisits(warc.captures_of_pages(_table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit(": "), h["value"])), "\n")
    return rows.withColumn("headers", lines)


def op8_quality_bytes(spark, sf_dir):
    """The quality score of every document by a network fitted on labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", quality.quality_held_out())
    labels = _table(spark, sf_dir, "labels").where(~quality.quality_held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality.predict(docs, quality.train(docs, labels), keep=("doc_id", "held_out"))


def op9_decontaminate(spark, sf_dir):
    """Words of each document inside 10-word windows of benchmark items."""
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key")


def op10_jaccard_join(spark, sf_dir):
    """The component of every document under links of 3-word shingle Jaccard 0.9 or more."""
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), k=3, percent=90).drop("text_key")


def op11_ranked_search(spark, sf_dir):
    """The 10 best documents of each benchmark item."""
    return signatures.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=10)


def op12_quality_rules(spark, sf_dir):
    """Counts and verdict of every document by cutoffs of its language and source."""
    return rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_align_tokenizers(spark, sf_dir):
    """Token groups and links of every document under two tokenizers, with corpus-wide counts of linked id pairs."""
    return alignment.align(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_remove_repeats, op2_mix_sources, op3_shard_slots, op4_fingerprint_chunks, op5_language_id, op6_judge_urls, op7_resolve_revisits, op8_quality_bytes, op9_decontaminate, op10_jaccard_join, op11_ranked_search, op12_quality_rules, op13_align_tokenizers)}
