"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points frac(i * phi), i = 0, 1, 2, ..., go through the cumulative
target weights, so slot i falls to a source and every stretch of the schedule
has the sources near their shares. A source's documents are shuffled by a hash
of their ids and laid end to end; the line is cut into blocks of equally many
words. The slots of a source are ranked, and the slot of rank r takes block
r mod (number of blocks), so a source that must give more than it has goes
round again, three times at most.

A source's block is 1/512 of what it has or must give, at most ``BLOCK`` words.
Sums along a source are taken in two steps, by the first 12 bits of the hash
and within them, so a source with a third of all documents is still many tasks.

Cases: null and blank texts have size 0 and nothing is taken from them; a null
source is one source, the last; equal ids keep an order by size, so equal rows
share alike; an empty table gives an empty mix; only id, source and text are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import fresh, row_key
from .shared import kept

BLOCK = 4096
PARTS = 512
MAX_TIMES = 3
CHUNK = 1 << 16
#: Cells of the cumulative weights, at least.
CELLS = 1024
BROADCAST_SOURCES = 100_000
PHI = 0.6180339887498949
#: frac(PHI * 2**20): keeps the fraction exact for large i.
PHI_20 = (PHI * (1 << 20)) % 1.0


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", key: Column | None = None) -> DataFrame:
    """doc_id, source and size in words of every document, with a key for the row."""
    return docs.select(
        (F.monotonically_increasing_id() if key is None else key).alias("key"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """A row for each source: number, source, source_size, weight, target, block, n_blocks and its stretch lo..hi of the schedule.

    Targets are shares by weight cut at MAX_TIMES the source's size, the excess
    shared anew: in the order of size for weight, a source is cut if its share
    of what the ones before leave is above its limit.
    """
    every = Window.partitionBy(F.lit(0))
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = table.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    table = table.withColumn("weight", (1 + F.col("number") % 3).cast("long")).withColumn("limit", MAX_TIMES * F.col("source_size"))
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    table = table.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    table = table.withColumn("cut", F.col("left").cast("decimal(38,0)") * F.col("weight") >= F.col("limit").cast("decimal(38,0)") * F.col("weights"))
    table = table.withColumn("open", F.min(F.when(~F.col("cut"), F.struct((F.col("limit") / F.col("weight")).alias("r"), "number", "left", "weights"))).over(every))
    share = (F.col("weight") * F.col("open.left")).cast("double") / F.col("open.weights").cast("double")
    table = table.withColumn("target", F.when(F.col("cut"), F.col("limit").cast("double")).otherwise(share))
    least = F.least(F.col("source_size").cast("double"), F.col("target"))
    table = table.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(least / PARTS))).cast("long"))
    table = table.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    table = table.withColumn("slots", F.round(F.col("target") / F.col("block")).cast("long"))
    table = table.withColumn("hi", F.sum("slots").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)))
    return table.select("number", "source", "source_size", "weight", "target", "block", "n_blocks", (F.col("hi") - F.col("slots")).alias("lo"), "hi")


def schedule(sources: DataFrame, slots: int, number: int = 1) -> DataFrame:
    """slot, number (of the source), rank (of the slot within its source); ``number``: how many sources there are, at most."""
    spark, cells = sources.sparkSession, max(CELLS, number)
    hint = F.broadcast if number <= BROADCAST_SOURCES else (lambda df: df)
    big, small = F.floor(F.col("id") / (1 << 20)), F.col("id") % (1 << 20)
    turn = big * F.lit(PHI_20)
    point = turn - F.floor(turn) + small * F.lit(PHI)
    place = ((point - F.floor(point)) * F.lit(float(slots))).alias("place")
    width = F.lit(max(1.0, slots / cells))
    points = spark.range(slots).select(F.col("id").alias("slot"), place).withColumn("cell", F.floor(F.col("place") / width))
    # each source stands in the cells that its stretch of weights touches, in all no more than cells and sources: points meet sources by cell
    stretches = sources.where("hi > lo").select("number", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("cell"))
    drawn = points.join(hint(stretches), "cell").where("place >= lo and place < hi").select("slot", "number", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    in_chunk = drawn.withColumn("at", F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1)
    counts = drawn.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("number", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return in_chunk.join(offsets, ["number", "chunk"]).select("slot", "number", (F.col("before") + F.col("at")).alias("rank"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", key: Column | None = None) -> DataFrame:
    """key, doc_id, source, size, source_size, target, taken of every document.

    ``key`` names a row; rows of one key and id are one, and ``taken`` is each one's even share. Without it each row is its own.
    """
    sizes = kept(sized(docs, doc_id, source, text, key))
    sources = kept(source_targets(sizes))
    total = sources.agg(F.count("*").alias("n"), F.max("hi").alias("slots")).first()
    few = total["n"] <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)

    takes = schedule(sources, total["slots"] or 0, total["n"]).join(hint(sources.select("number", "n_blocks")), "number")
    takes = takes.where(F.col("rank") < MAX_TIMES * F.col("n_blocks")).groupBy("number", (F.col("rank") % F.col("n_blocks")).alias("piece")).agg(F.count("*").alias("times"))

    name = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")]
    placed = sizes.select("*", *name).join(hint(sources.drop("source").join(sources.select("number", *name), "number")), ["name", "none"]).drop("name", "none")
    placed = placed.withColumn("order", F.sha2(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 256)).withColumn("part", F.substring("order", 1, 3))
    parts = placed.groupBy("number", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("number", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    along = Window.partitionBy("number", "part").orderBy("order", "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("to", F.sum("size").over(along)).join(bases, ["number", "part"])
    laid = laid.withColumn("to", F.col("base") + F.col("to")).withColumn("from", F.col("to") - F.col("size"))
    pieces = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("from") / F.col("block")), F.floor((F.col("to") - 1) / F.col("block"))))
    cut = laid.select("key", "doc_id", "source", "size", "source_size", "target", "number", "block", "from", "to", F.explode_outer(pieces).alias("piece"))
    words = F.least("to", (F.col("piece") + 1) * F.col("block")) - F.greatest("from", F.col("piece") * F.col("block"))
    got = cut.join(takes, ["number", "piece"], "left").withColumn("got", F.coalesce(words * F.col("times"), F.lit(0)))
    return got.groupBy("key", "doc_id", "source", "size", "source_size", "target").agg((F.sum("got") / (F.lit(1) if key is None else F.count_distinct("from"))).cast("long").alias("taken"))


#: What ``mixed`` adds to the documents' columns.
MIXED = ("size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, with their texts and MIXED (columns of these names are left out of the documents)."""
    k, i = fresh("_row_key", docs), fresh("_row_id", docs)
    taken = kept(mixture(docs, key=row_key()).where("taken > 0").select(F.col("key").alias(k), F.col("doc_id").alias(i), *MIXED))
    rest = docs.drop(*(c for c in docs.columns if c.lower() in MIXED))
    return rest.join(taken, (row_key() == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(i))).drop(k, i)
