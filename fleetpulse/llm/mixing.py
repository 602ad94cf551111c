"""Mixing sources to target weights, natively.

Each source is one stream of its documents' words in hashed order, packed into blocks of fixed
length; the last one may be shorter. A source gets as many slots as its target holds of its mean
block, rounded, one at least. The slots of all sources in a row are dealt to the output shards by
a pseudorandom permutation (swap-or-not rounds), so shards are of equal size and their source
counts are multinomial draws given each source's number of slots. The slots of a source are
numbered over all shards, and a permutation of the block indexes, one for each pass over the
source, says which block a slot holds. Slots and blocks join by (source, index).

Positions in a stream come from sums in two levels (chunks of a source, rows of a chunk), so a hot
source is many window partitions. Targets are per-source figures in one small window.

Defined cases: a null text has size 0 and is never taken; a null source is the last source. Rows with
the same doc_id are separate documents of their own sizes. An empty table gives no rows. A source
whose target is twice its size gives each block twice, hence each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import SPACES, stored, words

WEIGHTS = (5, 2, 1)
ROUNDS = 12
MADE = ("s", "size", "source_size", "target", "start", "chunk", "o", "taken", "row", "tie", "docs", "w", "inner")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: s (its number), source, docs, source_size, target.

    Targets share ``share`` times all sizes by weight; none exceeds ``most`` times its source's
    size. Sources ordered by that bound over weight are capped up to a point, so the level where
    the rest share by weight is a running sum.
    """
    rows = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    rows = rows.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumns({"cap": most * F.col("source_size"), "ratio": most * F.col("source_size") / F.col("w")})
    by = Window.orderBy("ratio", "s")
    rows = rows.withColumn("level", (share * F.sum("source_size").over(Window.partitionBy())
                                     - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
                           / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("target", F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(level * F.col("w"))).select(
        "s", "source", "docs", "source_size", "target")


def permuted(x: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. size - 1 chosen by ``key``: in each swap-or-not round
    x and its mirror at a keyed point change places or not, as a bit of their larger one says."""
    def step(acc: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), size) - acc, size)
        return F.when(F.xxhash64(key, r, F.greatest(acc, mirror)) % 2 == 0, mirror).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def streams(docs: DataFrame, targets: DataFrame, block: int, seed: int, chunk_docs: int) -> DataFrame:
    """``docs`` (with size) with the number and figures of their source and their first word's place in it."""
    df = docs.join(targets.withColumnRenamed("source", "source__"), F.col("source").eqNullSafe(F.col("source__"))).drop("source__")
    chunks = F.ceil(F.col("docs") / chunk_docs)
    df = df.withColumn("o", F.xxhash64("doc_id", "tie", F.lit(seed)))
    df = stored(df.withColumn("chunk", F.pmod(F.col("o"), chunks)), "mix-rows")
    sums = df.groupBy("s", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = F.sum("chunk_size").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("chunk_start", F.coalesce(before, F.lit(0))).drop("chunk_size")
    inner = Window.partitionBy("s", "chunk").orderBy("o", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["s", "chunk"])
            .withColumn("start", F.col("chunk_start") + F.col("inner")).drop("chunk", "o", "docs", "inner", "chunk_start"))


TASK_SLOTS = 1 << 18
RUN_SLOTS = 1 << 10


def slot_counts(targets: DataFrame, block: int) -> DataFrame:
    """For each source with a target: s, its blocks, n (its slots) and ahead (the slots of the sources before it)."""
    rows = targets.where("target > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    most = F.ceil(F.col("target") / F.col("source_size")) * F.col("blocks")
    mean = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    rows = rows.withColumn("n", F.least(F.greatest(mean, F.lit(1)), most))
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("s", "blocks", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))


def slots(targets: DataFrame, block: int, slots_per_shard: int, seed: int) -> DataFrame:
    """One row per slot of the mix: shard, s, t (its number in the source), block index, pass."""
    counts = slot_counts(targets, block)
    total = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // slots_per_shard))
    # The counts are few rows that stand for many slots: deal them by the slots they make, not by their bytes.
    runs = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN_SLOTS).cast("long"))).alias("first"))
    dealt = runs.repartition(max(1, -(-total // TASK_SLOTS)), "s", "first")
    last = F.least(F.col("first") + RUN_SLOTS, F.col("n")) - 1
    numbered = dealt.select("s", "blocks", "ahead", F.explode(F.sequence("first", last)).alias("t"))
    place = permuted(F.col("ahead") + F.col("t"), F.lit(total).cast("long"), F.lit(seed).cast("long"))
    turn = F.floor(F.col("t") / F.col("blocks"))
    return numbered.select(F.pmod(place, F.lit(shards)).alias("shard"), "s", "t", turn.alias("turn"),
                           permuted(F.pmod("t", F.col("blocks")), F.col("blocks"), F.xxhash64("s", turn, F.lit(seed))).alias("block"))


def row_keys() -> dict[str, Column]:
    """Two hashes that tell a document row; rows with both equal have one doc_id, text and source."""
    return {"row": F.xxhash64("doc_id", "text", "source"), "tie": F.xxhash64("text")}


def mix(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
        block: int = 64, slots_per_shard: int = 16_384, chunk_docs: int = 10_000, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """The documents in their streams (columns ``carry``, row, tie, s, size, source_size, target, start), and
    the pieces of the mix: shard, s, t, turn, start (of the document), first and n (words of it).
    Texts are read once for their sizes and stay where they are.

    Carried columns that clash with a made one are dropped.
    """
    carry = [c for c in carry if c.lower() not in MADE]
    need = [c for c in ("doc_id", "source") if c not in carry]
    keys = row_keys()
    sized = docs.select(*carry, *need, F.size(words(F.col("text"))).cast("long").alias("size"), *[c.alias(k) for k, c in keys.items()])
    facts = stored(sized, "mix-sizes")
    targets = stored(source_targets(facts, weights, share, most), "mix-targets")
    placed = stored(streams(facts, targets, block, seed, chunk_docs), "mix-streams")
    spans = placed.where("size > 0").select("s", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    # the slots come from few small rows, so that their size is underrated: they are never broadcast
    taken = slots(targets, block, slots_per_shard, seed).hint("merge").join(spans, ["s", "block"])
    begin, end = F.greatest(F.col("block") * block, F.col("start")), F.least(F.col("block") * block + block, F.col("start") + F.col("size"))
    return placed, taken.select("shard", "s", "t", "turn", "start", (begin - F.col("start")).alias("first"), (end - begin).alias("n"))


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``placed`` with ``taken``, the words the mix takes of each document."""
    sums = pieces.groupBy("s", "start").agg(F.sum("n").alias("taken"))
    # documents without words share their start with the next one
    filled = placed.where("size > 0").join(sums, ["s", "start"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    return filled.unionByName(none).withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_texts(docs: DataFrame, placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a source, every longest run of taken words is a
    row with the columns of ``docs`` and that run as its text, spaces within it as they were. Rows
    of ``docs`` equal in doc_id, text and source lend the columns of one of them."""
    runs = pieces.groupBy("s", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("p"))
    merged = F.aggregate("p", F.array().cast("array<struct<first:bigint,n:bigint>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["first"] + F.element_at(acc, -1)["n"] == x["first"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), (F.element_at(acc, -1)["n"] + x["n"]).alias("n")))))
        .otherwise(F.concat(acc, F.array(x))))
    runs = runs.select("s", "start", merged.alias("runs")).join(placed.where("size > 0").select("s", "start", "size", "row", "tie"), ["s", "start"])
    columns = [c for c in docs.columns if c.lower() not in {"row", "tie", "runs", "tokens", "size", "place"}]
    keyed = docs.select(*columns, *[c.alias(k) for k, c in row_keys().items()])
    one = keyed.withColumn("place", F.row_number().over(Window.partitionBy("row", "tie").orderBy("doc_id"))).where("place = 1")
    joined = one.join(runs.select("row", "tie", "size", "runs"), ["row", "tie"])
    # a word with the spaces before it, so that a slice joins to the text as it was
    space = "\\x20\\x09-\\x0D"
    tokens = F.regexp_extract_all("text", F.lit(f"[{space}]*[^{space}]+"), F.lit(0))
    whole = (F.size("runs") == 1) & (F.col("runs")[0]["n"] == F.col("size"))
    texts = F.when(whole, F.array("text")).otherwise(F.transform("runs", lambda r: F.ltrim(F.array_join(F.slice("tokens", (r["first"] + 1).cast("int"), r["n"].cast("int")), ""), F.lit(SPACES))))
    return joined.withColumn("tokens", F.when(~whole, tokens)).withColumn("text", F.explode(texts)).select(*columns)
