"""Benchmark decontamination with a distributed positional inverted index.

The words of all training texts are counted for the words that benchmark items use. Each item window (10
consecutive words) is looked up through its two rarest words: their postings (term, document, position) are
stored, shifted by the word's offset in the window, and intersected on (window, document, start), from the rarest list on. What is
left is compared word for word with the texts, so phrase matches are exact. Two
rare words that meet within ``slack`` positions of their place give a proximity match. DataFrame operations only.

Words are indexed in Unicode lower case, which words equal under A-Z lower-casing share; the exact comparison
uses A-Z lower-casing alone.

Plan: windows and terms go by 64-bit hashes (two of one hash give more to compare, never a wrong match), so postings and lists are rows of a few numbers; no array of words is ever a key or travels
beside another row. Texts that have (window, start) pairs left are picked by a broadcast of at most ``common.BROADCAST_ROWS`` counted
keys, else by one shuffle of the texts; only the picked ones meet the pairs. Postings, lists and look-ups are deleted once the matches are written.

Defined cases: a null or empty text has no words and is clean; an item without words occurs nowhere; an item of
fewer than 10 words is one window; repeated items each count, repeated windows are looked up once; null item
ids are left out of the list of items; documents with a null id are looked up like others; rows of equal id and text share their hits; equal ids with different texts are kept apart; empty tables give no
rows or no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import cut_lineage, delete_scratch, write_scratch
from .common import LETTER_RE, ascii_lower, count_words, let, small_or_joined, split_words

WINDOW = 10


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words) of each window of each item; words are A-Z lower-cased."""
    words = F.filter(split_words(ascii_lower(F.col(text_col)), LETTER_RE), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return (items.select(F.col(id_col).cast("string").alias("item_id"), words.alias("all")).where(F.size("all") > 0)
            .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words")))


def _keyed(docs: DataFrame) -> DataFrame:
    """(id_key, text_key, doc_id, text): two numbers, never null, that tell documents of different id or text apart."""
    none = F.col("doc_id").isNull()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id_key"),
                       F.xxhash64(none, F.coalesce("text", F.lit(""))).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _folded_words(text) -> Column:
    """The words in Unicode lower case; no letter changes between word and separator by it, so places stay the same."""
    return split_words(F.lower(text), LETTER_RE)


class Index:
    """Windows (win, words), look-ups (win, nth, term, at) of their two rarest terms, postings (term, id_key, text_key, pos)."""

    def __init__(self, docs: DataFrame, windows: DataFrame):
        self.spark, self.docs, self.paths = docs.sparkSession, _keyed(docs), []
        self.windows = windows.select("words").distinct().withColumn("win", F.xxhash64("words"))
        self.longest = max(windows.agg(F.max(F.size("words"))).first()[0] or 1, 1)
        placed = self.windows.select("win", F.posexplode(F.transform("words", F.lower)).alias("at", "word"))
        terms = placed.select("word").distinct().withColumn("term", F.xxhash64("word"))
        counted = terms.count()
        tokens = self.docs.select(F.explode(_folded_words(F.col("text"))).alias("word"))
        dfs = tokens.join(small_or_joined(terms, counted), "word").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        ranked = (placed.join(terms, "word").join(dfs, "term", "left").groupBy("win")
                  .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "at"))).alias("by_df")))
        # a window with a word that no text has occurs nowhere; one of a single word is looked up twice through it
        both = F.array(F.col("by_df")[0], F.coalesce(F.get("by_df", F.lit(1)), F.col("by_df")[0]))
        self.lookups = self._written(ranked.where(F.col("by_df")[0]["df"] > 0).select("win", F.posexplode(both).alias("nth", "x"))
                                     .select("win", "nth", "x.term", "x.at"), "lookups")
        self.n_lookups = self.lookups.count()
        wanted = terms.join(self.lookups.select("term").distinct(), "term", "left_semi")
        words = self.docs.select("id_key", "text_key", F.posexplode(_folded_words(F.col("text"))).alias("pos", "word"))
        self.postings = self._written(words.join(small_or_joined(wanted, counted), "word").select("term", "id_key", "text_key", "pos"), "postings")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = write_scratch(df, name)
        self.paths.append(path)
        return out

    def close(self) -> None:
        """Delete the index; what was made of it must have been written."""
        delete_scratch(self.spark, *self.paths)
        self.paths = []


def index(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> tuple[Index]:
    """The index of ``docs`` for ``windows`` (words)."""
    return (Index(docs, windows),)


def matches(found: Index, slack: int = 0) -> DataFrame:
    """(id_key, text_key, doc_id, words, start, exact): phrase matches, and with ``slack`` above 0 proximity matches;
    repeated documents give repeated rows.

    Starts are binned by slack + 1, so the two lists are joined on equal keys only. ``start`` counts a text's words from its first
    separator or word on.
    """
    keys = ["win", "id_key", "text_key"]

    def offsets(nth: int) -> DataFrame:
        part = small_or_joined(found.lookups.where(F.col("nth") == nth), found.n_lookups)
        return found.postings.join(part, "term").select(*keys, (F.col("pos") - F.col("at")).alias("start"))

    first, second = offsets(0), offsets(1)
    if slack:
        span = slack + 1
        first = first.withColumn("bin", F.floor(F.col("start") / span))
        second = second.withColumn("bin", F.explode(F.array(*[F.floor(F.col("start") / span) + i for i in (-1, 0, 1)])))
        second = second.withColumnRenamed("start", "start2").distinct()
        met = first.join(second, [*keys, "bin"]).where(F.abs(F.col("start") - F.col("start2")) <= slack).drop("bin", "start2").distinct()
    else:
        met = first.where("start >= 0").join(second, [*keys, "start"], "left_semi")
    places = found._written(met.groupBy("id_key", "text_key").agg(F.collect_set(F.struct("start", "win")).alias("places")), "places")
    # first the texts that have places, picked by their keys alone; of their words just the phrases leave the row
    held = small_or_joined(places.select("id_key", "text_key"), places.count())
    texts = found.docs.join(held, ["id_key", "text_key"], "left_semi").join(places, ["id_key", "text_key"])
    ws = F.transform(split_words(F.col("text"), LETTER_RE), ascii_lower)
    phrases = let(ws, lambda w: F.transform("places", lambda p: F.struct(
        p["win"].alias("win"), p["start"].alias("start"),
        F.slice(w, F.greatest(p["start"], F.lit(0)) + 1, F.lit(found.longest)).alias("phrase"))))
    rows = texts.select("id_key", "text_key", "doc_id", F.explode(phrases).alias("p")).select("id_key", "text_key", "doc_id", "p.*")
    rows = rows.join(small_or_joined(found.windows, found.n_lookups), "win")
    exact = (F.col("start") >= 0) & (F.slice("phrase", 1, F.size("words")) == F.col("words"))
    hits = rows.select("id_key", "text_key", "doc_id", "words", "start", exact.alias("exact"))
    return hits if slack else hits.where("exact")


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, phrase matches), both written."""
    windows = cut_lineage(item_windows(items, window), "windows")
    found = Index(docs, windows)
    hits = cut_lineage(matches(found), "matches")
    found.close()
    return windows, hits


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any phrase match, all columns kept."""
    found = find_matches(docs, items, window)[1].select(F.col("id_key").alias("_hit_id"), F.col("text_key").alias("_hit_key")).distinct()
    id_key = F.coalesce(docs["doc_id"].cast("long"), F.lit(0))
    text_key = F.xxhash64(docs["doc_id"].isNull(), F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, (id_key == found["_hit_id"]) & (text_key == found["_hit_key"]), "left_anti")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated), one row per document."""
    windows, found = find_matches(docs, items, window)
    doc = ["id_key", "text_key"]
    covered = (found.select(*doc, "start", F.size("words").alias("n")).distinct()
               .select(*doc, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
               .distinct().groupBy(*doc).agg(F.count(F.lit(1)).alias("n_hit")))
    seen = found.select(*doc, "words").distinct().join(windows.where("item_id is not null").distinct(), "words")
    listed = seen.select(*doc, "item_id").distinct().groupBy(*doc).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    hits = covered.join(listed, doc, "left")
    rows = _keyed(docs).select(*doc, "doc_id", count_words(F.col("text"), LETTER_RE).alias("n_words"))
    none = F.array().cast("array<string>")
    return (rows.join(hits, doc, "left")
            .select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated")))
