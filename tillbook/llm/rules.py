"""Quality rules whose cutoffs come from the corpus: quantile sketches by language and source.

Every document gets a few measures (symbols a word, letters a word, repeated lines, repeated word windows). For each
measure a quantile sketch is kept by (lang, source): counts of logarithmic buckets, exact below 64 and within 1/32 of
the value above it. Such counts are added to merge two sketches, in any order and with the same result, so
the sketch of a language or of all documents is the sum of its sources' sketches. A document is judged by
the sketch of its own language and source if that holds ``least`` documents, else by its language's, else by
that of all documents. It is dropped if a measure lies over q75 + 3 * (q75 - q25) + slack (letters a word also: under
q25 - 3 * (q75 - q25) - slack), or if it fails the fixed base rules. The slack keeps sources whose quartiles
coincide from dropping everything above them; for letters a word it shrinks with the root of the number of words,
as the spread of a mean does.

Plan: the measures are computed once inside each row and written (some 100 bytes a document); the sketch is a partial aggregate
of at most some 2,000 buckets a group and measure, so a source with a third of all rows is combined in each task; the
cutoffs, one row a group, come back by a join, broadcast only if counted within the bound. No text is shuffled.

Defined cases: a null text has no words; documents without words fail the base rules and feed no sketch; null
languages and sources are groups of their own; repeated rows are judged each; an empty table gives no rows;
other columns of the input are ignored unless named in ``keep``, whose names must not clash with the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.core import cut_lineage
from .common import SPACE_RE, let, small_or_joined

#: Fixed by the contract: white space of words, symbol characters, words of a window.
SPACES, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 5
#: Measure and slack, both in thousandths; ``word_len`` is bounded on both sides.
SLACK = {"symbols": 100, "dup_lines": 400, "repeats": 150, "word_len": 500}
#: Added to the slack of ``word_len``, divided by the root of the number of words.
SPREAD = 10_000.0
LEAST = 200


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words found twice or more in the array (at least one word long).

    Windows are compared by 64-bit hashes. Only an array that has a repeated window is sorted, as pairs of hash and
    position; covered words are counted from the distances of repeated windows.
    """
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(
            F.sort_array(F.transform(F.filter(s, lambda p, i: (
                (F.get(s, i - 1)["h"].eqNullSafe(p["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(p["h"])))), lambda p: p["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0), lambda total, x: total + x)))

    def by_hashes(hashed: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashed) - WINDOW),
                              lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]))
        return let(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(0))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), by_hashes)).cast("long")


def measure(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """``keep``, lang, source, n_words, the four counts of the base rules, n_lines (lines with a word) and base_failed."""
    trimmed = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES))
    kept = list(dict.fromkeys([*keep, "lang", "source"]))
    rows = docs.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias("_text"), trimmed.alias("_trimmed"))
    words = F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACE_RE, -1))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    without = lambda chars: F.char_length(F.translate("_text", chars, ""))
    rows = rows.select(*kept, counts.alias("_counts"), line_counts.alias("_lines"), without(SPACES).cast("long").alias("word_chars"),
                       (F.char_length("_text") - without(SYMBOLS)).cast("long").alias("n_symbols"))
    rows = rows.select(*kept, "_counts.n_words", "word_chars", "n_symbols", "_lines.n_dup_lines", "_counts.n_repeat_words", "_lines.n_lines")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def measures() -> dict[str, Column]:
    """The measures in thousandths, for rows of ``measure`` with at least one word."""
    return {"symbols": F.expr("1000 * n_symbols div n_words"), "dup_lines": F.expr("1000 * n_dup_lines div n_lines"),
            "repeats": F.expr("1000 * n_repeat_words div n_words"), "word_len": F.expr("1000 * word_chars div n_words")}


def sketch(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys, measure, bucket, n: how many values of each measure fall into each bucket of each group."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("long").alias("value")) for m, v in values.items()]))
    long = rows.select(*keys, each.alias("_m")).select(*keys, "_m.*")
    shift = F.greatest(F.length(F.bin("value")) - 6, F.lit(0))
    long = long.withColumn("_shift", shift).withColumn("bucket", F.expr("shiftleft(shiftright(value, _shift), _shift)"))
    return long.groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_docs and q25_<measure>, q75_<measure>: the first bucket that reaches a quarter, three quarters of the values."""
    group = Window.partitionBy(*keys, "measure")
    ranked = (sketches.withColumn("_upto", F.sum("n").over(group.orderBy("bucket")))
              .withColumn("_all", F.sum("n").over(group)))
    out = [F.max("_all").alias("n_docs")]
    for m in SLACK:
        for q in (1, 3):
            reached = (F.col("measure") == m) & (4 * F.col("_upto") >= q * F.col("_all"))
            out.append(F.min(F.when(reached, F.col("bucket"))).alias(f"q{25 * q}_{m}"))
    return ranked.groupBy(*keys).agg(*out)


def cutoffs(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source and the quartiles that hold for them: own, language's or of all, whichever has ``least`` documents first."""
    fine = cut_lineage(sketch(rows.where("n_words > 0"), ["lang", "source"], measures()), "sketch")
    own = quartiles(fine, ["lang", "source"])
    by_lang = quartiles(merged(fine, ["lang"]), ["lang"])
    overall = quartiles(merged(fine.withColumn("_one", F.lit(1)), ["_one"]), ["_one"])
    names = [c for c in own.columns if c not in ("lang", "source")]
    pick = lambda c: F.when(F.col("o.n_docs") >= least, F.col(f"o.{c}")).when(F.col("l.n_docs") >= least, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}"))
    return (own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")))
            .join(F.broadcast(overall.alias("a")))  # one row
            .select("o.lang", "o.source", *[pick(c).alias(c) for c in names]))


def judge(docs: DataFrame, keep=("doc_id",), least: int = LEAST) -> DataFrame:
    """``keep``, the counts, base_failed, failed (names of the measures out of bounds) and kept, for every document."""
    rows = cut_lineage(measure(docs, keep), "measures")
    limits = cut_lineage(cutoffs(rows, least), "cutoffs")
    values, tests = measures(), []
    for m, slack in SLACK.items():
        q1, q3 = F.col(f"c.q25_{m}"), F.col(f"c.q75_{m}")
        room = 3 * (q3 - q1) + slack
        if m == "word_len":
            room = room + F.lit(SPREAD) / F.sqrt(F.col("n_words").cast("double"))
            tests.append(F.when(values[m] < q1 - room, F.lit(m)))
        tests.append(F.when(values[m] > q3 + room, F.lit(m)))
    shown = [c for c in rows.columns if c not in ("lang", "source") or c in keep]
    limits = small_or_joined(limits, limits.count()).alias("c")
    out = rows.alias("d").join(limits, F.col("d.lang").eqNullSafe(F.col("c.lang")) & F.col("d.source").eqNullSafe(F.col("c.source")), "left")
    return (out.select(*[F.col(f"d.{c}").alias(c) for c in shown],
                       F.when(F.col("n_words") > 0, F.array_compact(F.array(*tests))).otherwise(F.array().cast("array<string>")).alias("failed"))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))


def good_documents(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents kept by ``judge``, with all their columns (the filter of a pipeline)."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    # columns travel under neutral names, so that none clashes with a result
    plain = docs.toDF(*names)
    position = {c.lower(): n for c, n in zip(docs.columns, names)}
    rows = plain.select(*names, *[F.col(position[c]).alias(c) for c in ("text", "lang", "source")])
    return judge(rows, keep=names, least=least).where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
