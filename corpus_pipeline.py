"""The corpus pipeline: language, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last return
the columns of documents. A stage's rows are written as Parquet and read again for the next one.

Defined cases: rows with null or letterless texts are rejected by the language stage; of repeated rows the join keeps
one; a document that the mix draws twice is two rows, one that it does not draw is gone, and texts are never cut; an empty
table stays empty. Null ids and sources
are handled by each operator as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.core import scratch_path
from tillbook.llm import decontam, jaccard, langid, mixing, sharding

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark, docs, sf_dir):
    """Documents in one of the languages that the given ``lang`` values teach; rejected ones go."""
    scored = langid.predict(docs, langid.train(docs), keep=COLUMNS)
    return scored.where("not rejected").select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group linked by 5-word shingle Jaccard of 0.8 or more."""
    return jaccard.one_of_each_group(docs.select(*COLUMNS))


def benchmark_leaks(spark, docs, sf_dir):
    """Documents without any 10-word window of a benchmark item."""
    return decontam.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark, docs, sf_dir):
    """The copies drawn by mixing sources with weights 3, 1, 2 to 150% of the words."""
    mix = mixing.mixture(docs, keep=("lang",))
    return mix.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def shards(spark, docs, sf_dir):
    """Every row with its shard of 24 and its place in it."""
    rows = sharding.shard_documents(docs, shards=24, keep=("text", "lang", "source", "n_chars"))
    return rows.select(*COLUMNS, "shard", F.col("slot").cast("long").alias("slot"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks),
          ("source_mix", source_mix), ("shards", shards)]

#: Language models and hashed draws have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
