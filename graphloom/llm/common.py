"""What the text operators share: reading, checkpoints, sorted groups and dealing of large groups."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in the shared folder of spark.checkpoint.dir, with as many files as df has partitions.

    On one machine, as in tests, a folder of our own will do where that is unset; on a cluster that is an error.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


#: Rows of a few numbers that may be broadcast (some 30 MB).
BROADCAST_ROWS = 300_000


def joinable(df: DataFrame) -> DataFrame:
    """df, which is counted here, to be broadcast if it has few rows; beyond, the join is by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Bits of a set of hashes that is sent to every task (1 MB). When it fills up, more hashes seem to be in it.
SET_BITS = 1 << 23


def bits_of(rows: DataFrame, column: str) -> Column:
    """A set of hashes as an array of longs, to be asked by has_bit(); it takes the same room whatever the rows."""
    word = F.shiftright(F.col(column).bitwiseAND(F.lit(SET_BITS - 1)), 6).cast("int").alias("word")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).bitwiseAND(F.lit(63)).cast("int"))
    found = rows.groupBy(word).agg(F.bit_or(mask).alias("mask"))
    every = rows.sparkSession.range(SET_BITS >> 6).select(F.col("id").cast("int").alias("word")).join(found, "word", "left")
    whole = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("a"))
    return whole.select(F.transform("a", lambda x: x["mask"])).scalar()


def has_bit(bits: Column, h: Column) -> Column:
    """True for every hash of the set, and for a share of all others, the same each time."""
    word = F.get(bits, F.shiftright(h.bitwiseAND(F.lit(SET_BITS - 1)), 6).cast("int"))
    return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def key_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Groups of batches that are sorted by integer keys; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    held_key: tuple[int, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for s, e in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            key = tuple(int(c[s]) for c in columns)
            if key != held_key and held:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(s, e - s))
    if held:
        yield held_key, pa.Table.from_batches(held)


def in_blocks(df: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Deal every group of over `limit` rows into blocks, and each row to all pairs of blocks that hold its own.

    Adds block (the row's own), lo and hi (the pair). Two rows of a group meet in one (lo, hi) at least, and in
    exactly one whose blocks are their own; no task gets more than about 2 * limit rows at once.
    """
    large = df.groupBy(*keys).count().where(F.col("count") > limit).withColumnRenamed("count", "n_group")
    blocks = F.ceil(F.coalesce("n_group", F.lit(1)) / F.lit(limit)).cast("int")
    df = df.join(large, keys, "left").withColumn("n_blocks", F.greatest(blocks, F.lit(1)))
    df = df.withColumn("block", F.pmod(F.xxhash64(member, F.lit(7)), F.col("n_blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    df = df.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return df.drop("n_group", "n_blocks", "other")


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each row of a symmetric boolean matrix."""
    n = len(linked)
    root = np.arange(n)
    rows, cols = np.nonzero(linked)
    while len(rows):
        new = root.copy()
        np.minimum.at(new, rows, root[cols])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root
