"""Mixing sources to target weights with exact quotas and a hypergeometric splitting tree.

Each source's rows are dealt into fixed blocks by a hash. A source whose target is p times its size and a
rest draws all its blocks p times and, in a further pass, blocks in permuted order (any that hold over a sixteenth of the rest
first) as long as they fit what is left of it. The smallest block that does not fit is opened: its lanes (a finer hash), and then the documents of the smallest lane that
does not fit, are taken by the same rule, and one more document if that comes nearer. No text is ever cut. The number of draws of
each source is its block quota. A binary tree over the output shards splits the quotas: at each node the left half of the
shards receives a multivariate hypergeometric draw of the node's blocks, which is what a uniform shuffle
of all blocks would give, without ever listing the blocks together. At a leaf the shard's quota of each source is
the next run of that source's permuted draws, so shards are disjoint; inside a shard rows are ordered by a hash.

DataFrame operations only. Tables besides the documents have one row per source and block (1,024 a
source); the tree works on one row per node that holds one number per source. An opened lane, some millionth of a source's
documents, is folded in one row.

Defined cases: a null text counts 0 words, is drawn like other documents and takes 0; a null source is a
source of its own, last in order; sources without words have target 0; null ids are hashed like values;
repeated rows are drawn alike (equal rows go together); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import cut_lineage, sequence_ids
from .common import SPACE_RE, count_words, let, small_or_joined, uniform

WEIGHTS = (3, 1, 2)
BLOCKS = 1024
#: Parts of an opened block.
LANES = 1024
SHARDS = 16


def _rank(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))


def with_block(docs: DataFrame, blocks: int = BLOCKS, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, rank, block, *keep): words and the block of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"),
                       count_words(F.col("text"), SPACE_RE).alias("size"), _rank(seed).alias("rank"), *[F.col(c) for c in keep])
    return rows.withColumn("block", F.pmod("rank", F.lit(blocks)).cast("int"))


def _lane(rank: str) -> Column:
    return F.pmod(F.shiftrightunsigned(rank, 20), F.lit(LANES)).cast("int")


def targets(sizes: DataFrame, share: float, limit: float, weights: tuple[int, ...]) -> DataFrame:
    """(idx, source, source_size, target) from (source, source_size), one row per source.

    The weighted shares of ``share`` times all words, each at most ``limit`` times its source; what is
    above goes to the others by weight. Every round brings two sums to the driver.
    """
    ordered = sequence_ids(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], start=-1, id_col="idx")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    table = ordered.select("idx", "source", "source_size", (F.lit(limit) * F.col("source_size")).alias("cap"),
                           weight[F.pmod("idx", F.lit(len(weights))).cast("int")].alias("weight"))
    level = -1.0
    total = float((table.agg(F.sum("source_size")).first()[0] or 0) * share)
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, free = table.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        raised = (total - (capped or 0.0)) / free
        if raised <= level:
            break
        level = raised
    return table.select("idx", "source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked among ``drawn`` of ``total``, by inversion of u.

    Weights are built outwards from the mode, 12 standard deviations each way; all weight beyond is smaller
    than the precision of a double.
    """
    def bounds(p: Column) -> Column:
        t, k, n = p["t"], p["k"], p["n"]
        spread = F.sqrt(F.greatest(n * k / t * (1 - k / t) * (t - n) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0)))
        low, high = F.greatest(n - (t - k), F.lit(0.0)), F.least(n, k)
        mode = F.least(F.greatest(F.floor((n + 1) * (k + 1) / (t + 2)).cast("double"), low), high)
        reach = F.ceil(spread * 12).cast("double") + 2
        return F.struct(t.alias("t"), k.alias("k"), n.alias("n"), p["u"].alias("u"), mode.alias("mode"),
                        F.greatest(low, mode - reach).alias("low"), F.least(high, mode + reach).alias("high"))

    def weights(b: Column) -> Column:
        t, k, n = b["t"], b["k"], b["n"]
        one = F.array(F.lit(1.0))
        step = lambda sign: lambda out, i: F.concat(out, F.array(F.element_at(out, -1) * sign(b["mode"], i)))
        rise = lambda m, i: (k - m - i + 1) * (n - m - i + 1) / ((m + i) * (t - k - n + m + i))
        fall = lambda m, i: (m - i + 1) * (t - k - n + m - i + 1) / ((k - m + i) * (n - m + i))
        count = lambda x: F.sequence(F.lit(1), x.cast("int"))
        up = F.when(b["high"] > b["mode"], F.aggregate(count(b["high"] - b["mode"]), one, step(rise))).otherwise(one)
        down = F.when(b["low"] < b["mode"], F.aggregate(count(b["mode"] - b["low"]), one, step(fall))).otherwise(one)
        whole = F.concat(F.reverse(F.slice(down, F.lit(2), F.size(down))), up)
        return F.struct(b["low"].alias("low"), b["u"].alias("u"), whole.alias("w"))

    def pick(c: Column) -> Column:
        goal = c["u"] * F.aggregate(c["w"], F.lit(0.0), lambda a, x: a + x)
        end = F.aggregate(c["w"], F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("at"), goal.alias("goal")), lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), F.when(s["sum"] + x < s["goal"], s["at"] + 1).otherwise(s["at"]).alias("at"), s["goal"].alias("goal")))
        return c["low"] + F.least(end["at"], F.size(c["w"]).cast("double") - 1)

    p = F.struct(total.cast("double").alias("t"), marked.cast("double").alias("k"), drawn.cast("double").alias("n"), u.alias("u"))
    return let(let(let(p, bounds), weights), pick).cast("long")


def _split(quotas: Column, drawn: Column, node: Column, seed: int) -> Column:
    """The left child's quotas (array of idx, q): one conditional hypergeometric draw after another."""
    rest = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x["q"])
    start = F.struct(rest.alias("rest"), drawn.cast("long").alias("drawn"),
                     F.array().cast("array<struct<idx:bigint,q:bigint>>").alias("out"))

    def one(s: Column, x: Column) -> Column:
        got = F.when((s["drawn"] == 0) | (x["q"] == 0), F.lit(0).cast("long")).when(s["drawn"] == s["rest"], x["q"]).otherwise(
            hypergeometric(s["rest"], x["q"], s["drawn"], uniform(F.lit(seed), node, x["idx"])))
        return let(got, lambda g: F.struct(
            (s["rest"] - x["q"]).alias("rest"), (s["drawn"] - g).alias("drawn"),
            F.concat(s["out"], F.array(F.struct(x["idx"].alias("idx"), g.alias("q")))).alias("out")))
    return F.aggregate(quotas, start, one)["out"]


def shard_quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(idx, ends): for each source the running total of its block quota over the shards 0, 1, ...

    ``draws`` has (idx, q). A node covers the shards [first, first + width) and is split until width is 1.
    """
    nodes = (draws.agg(F.sort_array(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("q").cast("long").alias("q")))).alias("quotas"))
             .select(F.lit(0).alias("first"), F.lit(shards).alias("width"), "quotas"))
    width = shards
    while width > 1:
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        left = F.floor(F.col("width") / 2).cast("int")
        drawn = F.floor(total * left / F.col("width")).cast("long")
        nodes = (nodes.withColumn("left", F.when(F.col("width") > 1, _split(F.col("quotas"), drawn, F.struct("first", "width"), seed))
                                  .otherwise(F.col("quotas")))
                 .select(F.explode(F.when(F.col("width") > 1, F.array(
                     F.struct("first", left.alias("width"), F.col("left").alias("quotas")),
                     F.struct((F.col("first") + left).alias("first"), (F.col("width") - left).alias("width"),
                              F.zip_with("quotas", "left", lambda a, b: F.struct(a["idx"].alias("idx"), (a["q"] - b["q"]).alias("q"))).alias("quotas"))))
                     .otherwise(F.array(F.struct("first", "width", "quotas")))).alias("n")).select("n.*"))
        nodes = cut_lineage(nodes, "mix-tree")
        width = (width + 1) // 2
    per = nodes.select(F.col("first").alias("shard"), F.explode("quotas").alias("x")).select("shard", "x.idx", "x.q")
    running = F.sum("q").over(Window.partitionBy("idx").orderBy("shard"))
    return (per.withColumn("end", running).groupBy("idx")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends")))


def _fitting(items: Column, left: Column, key_type: str) -> Column:
    """Take items (struct of order, key, words; in order) with words as long as they fit: (left, taken, smallest, words).

    ``smallest`` is the key of the smallest item that did not fit, ``words`` its size.
    """
    start = F.struct(left.cast("long").alias("left"), F.array().cast(f"array<{key_type}>").alias("taken"),
                     F.lit(None).cast(key_type).alias("smallest"), F.lit(None).cast("long").alias("words"))

    def one(s: Column, x: Column) -> Column:
        fits = (x["words"] > 0) & (x["words"] <= s["left"])
        smaller = ~fits & (x["words"] > 0) & (s["words"].isNull() | (x["words"] < s["words"]))
        return F.struct(F.when(fits, s["left"] - x["words"]).otherwise(s["left"]).alias("left"),
                        F.when(fits, F.concat(s["taken"], F.array(x["key"]))).otherwise(s["taken"]).alias("taken"),
                        F.when(smaller, x["key"]).otherwise(s["smallest"]).alias("smallest"),
                        F.when(smaller, x["words"]).otherwise(s["words"]).alias("words"))
    return F.aggregate(F.sort_array(items), start, one)


def _items(key: str, left: str, seed: int) -> Column:
    """Items in permuted order, those of over a sixteenth of ``left`` before all others: later they would not fit."""
    return F.collect_list(F.struct((F.col("words") * 16 <= F.col(left)).alias("small"), F.xxhash64(F.lit(seed), F.col("idx"), F.col(key)).alias("order"), F.col(key).alias("key"), F.col("words").alias("words")))


def open_blocks(docs: DataFrame, opened: DataFrame, n_sources: int, blocks: int, seed: int) -> DataFrame:
    """(idx, lanes, ranks): what is taken of each opened block, as whole lanes and as single documents by rank.

    ``opened`` has (idx, source, block, left), at most one row a source. Only the documents of these blocks are counted again.
    """
    rows = docs.select(F.col("source"), _rank(seed).alias("rank"), F.col("text")).withColumn("block", F.pmod("rank", F.lit(blocks)).cast("int"))
    units = (rows.alias("r").join(small_or_joined(opened, n_sources).alias("o"),
                                  F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.block") == F.col("o.block")))
             .select("o.idx", "o.left", "r.rank", count_words(F.col("r.text"), SPACE_RE).alias("words"))
             .groupBy("idx", "rank").agg(F.first("left").alias("left"), F.sum("words").alias("words")))
    units = cut_lineage(units.withColumn("lane", _lane("rank")), "mix-units")
    lanes = (units.groupBy("idx", "lane").agg(F.first("left").alias("left"), F.sum("words").alias("words"))
             .groupBy("idx").agg(_fitting(_items("lane", "left", seed + 3), F.first("left"), "int").alias("f"))
             .select("idx", F.col("f.taken").alias("lanes"), F.col("f.left").alias("open_left"), F.col("f.smallest").alias("open_lane")))
    lanes = cut_lineage(lanes, "mix-lanes")
    inside = (units.join(small_or_joined(lanes.where("open_left > 0"), n_sources), "idx").where("lane = open_lane")
              .groupBy("idx").agg(_fitting(_items("rank", "open_left", seed + 4), F.first("open_left"), "bigint").alias("f"))
              .select("idx", F.when(F.col("f.words") < 2 * F.col("f.left"), F.concat("f.taken", F.array("f.smallest"))).otherwise(F.col("f.taken")).alias("ranks")))
    return lanes.join(inside, "idx", "left").select("idx", "lanes", F.coalesce("ranks", F.array().cast("array<bigint>")).alias("ranks"))


def mix_plan(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS,
             blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(source, block, source_size, target, draws, lanes, ranks): what is drawn of each block.

    ``draws`` is an array of (pass, shard, opened). Of a block drawn as opened only the documents of ``lanes`` and those
    with one of ``ranks`` are taken; other blocks have neither.
    """
    sized = cut_lineage(with_block(docs, blocks, seed).groupBy("source", "block").agg(
        F.sum("size").cast("long").alias("words")), "mix-blocks")
    goal = cut_lineage(targets(sized.groupBy("source").agg(F.sum("words").alias("source_size")), share, limit, weights), "mix-targets")
    n_sources = goal.count()
    table = sized.join(small_or_joined(goal, n_sources), sized["source"].eqNullSafe(goal["source"])).select(
        "idx", sized["source"], "block", "words", "source_size", "target")
    asked = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(asked / F.col("source_size"))).otherwise(0).cast("int")
    table = table.withColumn("whole", whole).withColumn("rest", asked - F.col("whole") * F.col("source_size"))
    partly = cut_lineage(table.groupBy("idx").agg(F.first("source").alias("source"), F.first("whole").alias("pass"),
                                                  _fitting(_items("block", "rest", seed), F.first("rest"), "int").alias("f"))
                         .select("idx", "source", "pass", "f.*"), "mix-partly")
    opened = partly.where("left > 0 and smallest is not null").select("idx", "source", "pass", "left", F.col("smallest").alias("block"))
    drawn = (table.where("whole > 0").select("idx", "block", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("pass"), F.lit(False).alias("opened"))
             .unionByName(partly.select("idx", F.explode("taken").alias("block"), "pass", F.lit(False).alias("opened")))
             .unionByName(opened.select("idx", "block", "pass", F.lit(True).alias("opened"))))
    place = Window.partitionBy("idx").orderBy("pass", F.xxhash64(F.lit(seed), "idx", "pass", "block"))
    drawn = cut_lineage(drawn.withColumn("at", F.row_number().over(place) - 1), "mix-draws")
    ends = shard_quotas(drawn.groupBy("idx").agg(F.count(F.lit(1)).alias("q")), shards, seed)
    drawn = drawn.join(small_or_joined(ends, n_sources), "idx").groupBy("idx", "block").agg(F.sort_array(F.collect_list(F.struct(
        "pass", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"), "opened"))).alias("draws"))
    parts = open_blocks(docs, opened, n_sources, blocks, seed).join(opened.select("idx", "block"), "idx")
    return cut_lineage(table.join(drawn, ["idx", "block"], "left").join(parts, ["idx", "block"], "left").select(
        "source", "block", "source_size", "target",
        F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int,opened:boolean>>")).alias("draws"), "lanes", "ranks"), "mix-plan")


def mix_documents(docs: DataFrame, keep: tuple[str, ...] = (), seed: int = 0, blocks: int = BLOCKS, **plan) -> DataFrame:
    """(doc_id, size, source_size, target, taken, draws, *keep), one row per document.

    ``draws`` is an array of (pass, shard, order, words): the copies of this document, each with its output
    shard, its place in the shard's local shuffle and its words. ``taken`` is their sum.
    """
    plan_rows = mix_plan(docs, blocks=blocks, seed=seed, **plan)
    rows = with_block(docs, blocks, seed, keep)
    joined = rows.alias("r").join(small_or_joined(plan_rows, plan_rows.count()).alias("p"),
                                  F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.block") == F.col("p.block")))
    inside = F.array_contains("p.lanes", _lane("r.rank")) | F.array_contains("p.ranks", F.col("r.rank"))
    copies = F.transform(F.filter("p.draws", lambda d: ~d["opened"] | inside), lambda d: F.struct(
        d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed + 2), d["pass"], F.col("r.rank")).alias("order"), F.col("r.size").alias("words")))
    return joined.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
        F.col("copies").alias("draws"), *[F.col(f"r.{c}") for c in keep if c != "source"], F.col("r.source").alias("source"))


def mixture(docs: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The mix itself: one row per drawn copy, (doc_id, source, text, *keep, shard, pass, order, words).

    Documents without words are copied with their block. Sorted by ``order`` inside a shard when written: ``write_mixture``.
    """
    rows = mix_documents(docs, keep=("text", *keep), **options)
    copies = rows.select("doc_id", "source", "text", *keep, F.explode("draws").alias("d"))
    return copies.select("doc_id", "source", "text", *keep, "d.shard", "d.pass", "d.order", "d.words")


def write_mixture(mix: DataFrame, path: str, tasks_per_shard: int = 8) -> None:
    """Parquet with one folder per shard; each shard is written by several tasks, each sorted by the local shuffle."""
    lane = F.pmod(F.shiftrightunsigned("order", 50), F.lit(tasks_per_shard))
    (mix.withColumn("_lane", lane).repartition("shard", "_lane").sortWithinPartitions("shard", "order").drop("_lane")
     .write.partitionBy("shard").parquet(path))
