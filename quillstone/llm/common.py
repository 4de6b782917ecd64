"""What several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a piece of an Arrow batch whose texts are held as Python strings at once.
PIECE = 256
#: Bits that tell which texts are wanted.
WANTED = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder, which all executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset (tests on
    one machine) a temporary folder stands in.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillstone-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def clear(spark: SparkSession) -> None:
    """Have the driver collect garbage: only then Spark deletes files of shuffles and checkpoints that nothing refers to.

    Python first, as its handles of Java objects are in cycles.
    """
    gc.collect()
    spark._jvm.System.gc()


def parted(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose doc_id is not in wanted, which should be cut; and the others, with some that aren't in it either.

    Bits of hashes of the wanted ids, of which there are as many at any size, tell rows that
    are not among them, so that only the others need be shuffled to be told by the ids themselves.
    """
    at = lambda: F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(WANTED))
    words = wanted.select(at().alias("at")).groupBy(F.shiftright("at", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("__bits"))
    marked = rows.withColumn("__at", at()).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(words), "__word", "left")
    marked = marked.withColumn("__may", F.coalesce(F.expr("shiftrightunsigned(__bits, cast(__at & 63 as int)) & 1L"), F.lit(0)) == 1)
    return marked.filter(~F.col("__may")).select(*rows.columns), marked.filter("__may").select(*rows.columns)


def give_back() -> None:
    """Return to the system what this process has freed: a worker outlives its task, and would hold it until it ends."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that long texts stay few in memory.

    With most, a piece ends with the row that brings it to so many bytes. Behind the last
    piece, memory that the task has freed is given back.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, size)
            if most and piece.nbytes > most and piece.num_rows > 1:
                low, high = 1, piece.num_rows
                while low < high:
                    half = (low + high) // 2
                    low, high = (low, half) if piece.slice(0, half).nbytes >= most else (half + 1, high)
                piece = piece.slice(0, low)
            yield piece
            at += piece.num_rows
        batch = piece = None
    give_back()


def held_out(column: str = "doc_id"):
    """True for the fifth of the rows that no model here may learn from."""
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, target: str, bound: int, *, fold: bool) -> list:
    """At most `bound` rows (doc_id, text, target) that a classifier may learn from, sorted by doc_id.

    The rows are those with the smallest hash of doc_id, so the sample is the same
    on every run and however the tables are laid out. Its ids are at most `bound` longs,
    which makes their broadcast bounded. A doc_id with several labels has the greatest one,
    one with several texts the least one (null: empty). With fold, rows of the held-out
    fifth are never taken.
    """
    pick = labels.select("doc_id", F.col(target).cast("int").alias("target")).dropna()
    if fold:
        pick = pick.filter(~held_out())
    pick = pick.groupBy("doc_id").agg(F.max("target").alias("target")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("target").alias("target"))
    return sorted(rows.collect(), key=lambda r: r.doc_id)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Alternating large-star and small-star rounds; each is an aggregate to the
    smallest neighbour and a join back, so a centre with very many neighbours is
    split by the skew join instead of being gathered in one task. Every round is
    written to the checkpoint folder. Edges may be repeated or point either way;
    rows with a null end are ignored.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = cut(now.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        after = cut(moved.distinct())
        # A star forest is left as it is: every node has one neighbour, a centre.
        twice = after.groupBy("u").count().filter("count > 1").limit(1)
        chained = after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
        now = after
        if twice.isEmpty() and chained.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle; raise rounds")
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
