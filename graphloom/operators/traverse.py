"""Reachability, distances and paths over edge tables (source, target).

Closures run round by round: a round joins the newest pairs with the edges and drops what is known, so work follows the
size of the result and cycles end by themselves. From many starts, edges are first joined to strides of up to eight hops,
which takes an eighth of the rounds. All state is in tables, cut off by checkpoints in the shared folder.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.bits import all_reached
from graphloom.sources.store import TRAVERSAL

#: Rounds between checkpoints of all that is known.
EVERY = 4
#: The longest stride, and how many edges for each start make strides worth their while.
STRIDE, MANY = 8, 16
#: Starts whose pairs are stored at once, and the longest stride then: longer ones take more room than the pairs.
PART, PART_STRIDE = 2_500_000, 4
#: Edges and names of nodes that the driver and each task may hold; an edge is four numbers.
FEW_EDGES, FEW_NODES = 16_000_000, 4_000_000

#: How a table is stored.
Keep = Callable[[DataFrame], DataFrame]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in the shared folder of spark.checkpoint.dir; on one machine one of our own will do where that is unset."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """As cut(), compressed and by columns: readers get the columns that they ask for, and plans know how large the table is. Its path is added to paths."""
    spark = df.sparkSession
    cut(spark.range(0))  # sets the folder where it is unset
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Shelf:
    """Stored tables that go together, once what was made of them is stored elsewhere."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.spark = None

    def keep(self, df: DataFrame) -> DataFrame:
        """stored(); what Spark shuffled for the table goes now and not when its driver happens to collect garbage."""
        out, self.spark = stored(df, self.paths), df.sparkSession
        self.sweep()
        return out

    def sweep(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self, but_last: int = 0) -> None:
        gone = self.paths[: len(self.paths) - but_last]
        self.paths = self.paths[len(gone) :]
        for p in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def hashes_tell_apart(ids: DataFrame) -> bool:
    """Whether no two of the ids (h, h2: xxhash64 with two seeds) have the same h."""
    return ids.groupBy("h").agg((F.min("h2") != F.max("h2")).alias("two")).where("two").isEmpty()


def two_hashes(column: str, h: str = "h", h2: str = "h2"):
    return F.xxhash64(column).alias(h), F.xxhash64(F.lit(7), column).alias(h2)


def traversal_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relation").isin(*TRAVERSAL)).select("source", "target").distinct()


def call_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relation") == "calls").select("source", "target").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def closure(starts: DataFrame, edges: DataFrame, max_hops: int = 0) -> DataFrame:
    """(start, node, distance): all that each start reaches, itself at distance 0, by the least number of hops.

    starts: a column of ids, read as `start`. Ids without a node row count. max_hops 0: without bound.
    """
    seen, step, stride = _steps(starts, edges, max_hops, cut)
    return _rounds(seen, step, stride, max_hops, cut)


def closure_in_parts(starts: DataFrame, edges: DataFrame, made_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """made_of(closure()) of all starts, for what is made of the pairs of each start by itself: of so many starts at a time, so that all pairs are never stored at once."""
    shelf, steps, done = Shelf(), Shelf(), []
    seen, step, stride = _steps(starts, edges, 0, shelf.keep, steps.keep, PART_STRIDE, lambda: steps.clear(but_last=1))
    parts = -(-seen.count() // PART) or 1
    for k in range(parts):
        own = Shelf()
        pairs = _rounds(seen.where(F.pmod(F.xxhash64("start"), F.lit(parts)) == k), step, stride, 0, own.keep)
        done.append(stored(made_of(pairs)))
        own.clear()
    shelf.sweep()
    shelf.clear()
    steps.clear()
    return reduce(DataFrame.union, done)


def _steps(starts: DataFrame, edges: DataFrame, max_hops: int, keep: Keep, keep_step: Keep | None = None, most: int = STRIDE, accepted: Callable[[], None] = lambda: None) -> tuple[DataFrame, DataFrame, int]:
    keep_step = keep_step or keep
    step = keep_step(edges.select(F.col("source").alias("node"), F.col("target").alias("next")).where("node <> next").distinct())
    seen = keep(starts.toDF("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("distance")))
    step = step.withColumn("hops", F.lit(1))
    if seen.count() * MANY > step.count():
        return seen, *_strides(step, min(most, max_hops or most), keep_step, accepted)
    return seen, step, 1


def _rounds(seen: DataFrame, step: DataFrame, stride: int, max_hops: int, keep: Keep) -> DataFrame:
    front, done, rounds = seen, 0, 0
    while not max_hops or done < max_hops:
        found = front.join(step, "node").select("start", F.col("next").alias("node"), (F.col("distance") + F.col("hops")).alias("distance"))
        if max_hops:
            found = found.where(F.col("distance") <= max_hops)
        found = found.groupBy("start", "node").agg(F.min("distance").alias("distance"))
        new = keep(found.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if new.isEmpty():
            break
        rounds, done = rounds + 1, done + stride
        seen = keep(seen.unionByName(new)) if rounds % EVERY == 0 else seen.unionByName(new)
        # what lies further is reached through a node at just this distance
        front = new.where(F.col("distance") == done)
    return seen


def _strides(step: DataFrame, most: int, keep: Keep, accepted: Callable[[], None] = lambda: None) -> tuple[DataFrame, int]:
    """(node, next, hops) of all that is reached in 1 to n hops, and n: doubled up to `most` while the table no more than triples."""
    n, reach = step.count(), 1
    while 2 * reach <= most:
        on = step.select(F.col("node").alias("next"), F.col("next").alias("end"), F.col("hops").alias("more"))
        longer = step.join(on, "next").select("node", F.col("end").alias("next"), (F.col("hops") + F.col("more")).alias("hops")).where("node <> next")
        both = keep(step.unionByName(longer).groupBy("node", "next").agg(F.min("hops").alias("hops")))
        if (now := both.count()) > 3 * n:
            break
        step, n, reach = both, now, 2 * reach
        accepted()  # the steps before are not read any more
    return step, reach


def cyclic_closure(edges: DataFrame) -> DataFrame:
    """(start, node, distance) of all that each source reaches over one edge or more; itself by its shortest cycle, if it lies on one."""
    step = stored(edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).dropna().distinct())
    return all_reached(step) if _held(step) else joined_closure(edges)


def _held(step: DataFrame) -> bool:
    """Whether the edges are few enough for all_reached()."""
    n = step.count()
    return n <= FEW_EDGES and (2 * n <= FEW_NODES or step.select("source").union(step.select("target")).distinct().count() <= FEW_NODES)


def joined_closure(edges: DataFrame) -> DataFrame:
    """cyclic_closure() by joins, for edges that are too many for one task."""
    pairs = closure(edges.select("source"), edges)
    back = edges.select(F.col("source").alias("node"), F.col("target").alias("start"))
    cycles = pairs.join(back, ["start", "node"]).groupBy("start").agg((F.min("distance") + 1).alias("distance"))
    return pairs.where("distance > 0").unionByName(cycles.withColumn("node", F.col("start")))


def doubled_closure(edges: DataFrame) -> DataFrame:
    """(start, node, distance) of all pairs, distance 1 or more except on cycles, by squaring: a number of rounds that is the logarithm of the longest distance."""
    pairs = cut(edges.select(F.col("source").alias("start"), F.col("target").alias("node"), F.lit(1).alias("distance")).distinct())
    size = pairs.count()
    while True:
        on = pairs.select(F.col("start").alias("node"), F.col("node").alias("end"), F.col("distance").alias("more"))
        longer = pairs.join(on, "node").select("start", F.col("end").alias("node"), (F.col("distance") + F.col("more")).alias("distance"))
        pairs = cut(pairs.unionByName(longer).groupBy("start", "node").agg(F.min("distance").alias("distance")))
        now = pairs.agg(F.count("*"), F.sum("distance")).first()
        if tuple(now) == size:
            return pairs
        size = tuple(now)


def reachable_sets(nodes: DataFrame, edges: DataFrame, max_hops: int = 0) -> DataFrame:
    """closure() of the entry points over the traversal relations."""
    entries = nodes.where((F.col("type") == "function") & F.col("visibility").isin("public", "external")).select("id")
    return closure(entries, traversal_edges(edges), max_hops)


def simple_paths(starts: DataFrame, ends: DataFrame, edges: DataFrame, max_depth: int = 15, max_paths: int = 0) -> DataFrame:
    """(start, end, path, length): paths that visit no node twice, of max_depth edges at most, by length and then by ids.

    starts and ends: a column of ids each; a start that is also an end gives no path of its own. max_paths bounds the
    result of each pair; 0: all. Only what can still reach an end is extended.
    """
    step = edges.select(F.col("source").alias("at"), F.col("target").alias("next")).distinct()
    goal = ends.toDF("end").distinct()
    useful = closure(goal.withColumnRenamed("end", "start"), reversed_edges(edges), max_depth).select(F.col("node").alias("next")).distinct()
    step = cut(step.join(useful, "next", "left_semi"))
    paths = starts.toDF("start").distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path"))
    found = None
    if max_paths:  # what each start can still be asked for
        wanted = closure(starts.toDF("start"), step.select(F.col("at").alias("source"), F.col("next").alias("target")), max_depth).where("distance > 0")
        wanted = cut(wanted.join(goal, F.col("node") == F.col("end")).select("start", "end"))
    for hops in range(1, max_depth + 1):
        if max_paths and found is not None:
            full = found.groupBy("start", "end").count().where(F.col("count") >= max_paths)
            paths = paths.join(wanted.join(full, ["start", "end"], "left_anti").select("start").distinct(), "start", "left_semi")
        paths = paths.join(step, "at").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"))
        paths = cut(paths)
        if paths.isEmpty():
            break
        here = paths.join(goal, F.col("at") == F.col("end")).select("start", "end", "path", F.lit(hops).alias("length"))
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = paths.join(goal, F.col("at") == F.col("end")).select("start", "end", "path", F.lit(0).alias("length")).where("false")
    if not max_paths:
        return found
    from pyspark.sql import Window

    order = Window.partitionBy("start", "end").orderBy("length", F.array_join("path", "\x00"))
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_paths).drop("_n")


def shortest_path(starts: DataFrame, ends: DataFrame, edges: DataFrame, max_depth: int = 15) -> DataFrame:
    """(start, end, path, length): of the shortest paths of each pair, of max_depth edges at most, the first by ids.

    The distance of every node to an end is known first; then each pair holds one path, which goes on to the smallest
    node that is one edge nearer.
    """
    back = closure(ends, reversed_edges(edges), max_depth).select(F.col("start").alias("end"), F.col("node").alias("next"), "distance")
    step = edges.select(F.col("source").alias("at"), F.col("target").alias("next")).distinct()
    first = starts.toDF("start").distinct().join(back, F.col("start") == F.col("next")).where("distance > 0")
    at = cut(first.select("start", "end", F.col("start").alias("at"), "distance", F.array("start").alias("path")))
    found = []
    while not at.isEmpty():
        on = at.join(step, "at").select("start", "end", "path", "next", (F.col("distance") - 1).alias("distance")).join(back, ["end", "next", "distance"], "left_semi")
        on = on.groupBy("start", "end", "path", "distance").agg(F.min("next").alias("at"))
        on = cut(on.select("start", "end", "at", "distance", F.array_append("path", F.col("at")).alias("path")))
        found.append(on.where("distance = 0"))
        at = on.where("distance > 0")
    none = at.where("false")
    return reduce(DataFrame.union, found, none).select("start", "end", "path", (F.size("path") - 1).alias("length"))


def propagate_sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, sink, distance): functions that call a sink through functions only, with the sink found first (nearest, then by id). Sinks themselves are left out."""
    from graphloom.functions.payload import attr_enabled

    sinks = nodes.where(attr_enabled("metadata", "is_sink")).select("id")
    functions = nodes.where("type = 'function'").select("id")
    back = reversed_edges(call_edges(edges)).join(functions.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    reached = closure(sinks, back).where("distance > 0")
    first = reached.groupBy(F.col("node").alias("id")).agg(F.min(F.struct("distance", "start")).alias("f"))
    return first.join(sinks, "id", "left_anti").select("id", F.col("f.start").alias("sink"), F.col("f.distance").alias("distance"))


def all_callers_guarded(functions: DataFrame, edges: DataFrame, guarded: DataFrame) -> DataFrame:
    """(id): of functions those that someone calls and that are reached through guarded callers only; cycles of callers count as guarded.

    functions: ids to judge and pass through. A function that nobody calls and no guard protects spoils all it reaches
    through unguarded functions, which is what is computed.
    """
    calls = call_edges(edges)
    loose = functions.select("id").join(guarded.select("id"), "id", "left_anti")
    called = calls.select(F.col("target").alias("id")).distinct()
    open_ends = loose.join(called, "id", "left_anti")
    through = calls.join(loose.withColumnRenamed("id", "source"), "source", "left_semi").join(loose.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    spoiled = closure(open_ends, through).select(F.col("node").alias("id")).distinct()
    return loose.join(called, "id", "left_semi").join(spoiled, "id", "left_anti")


def inherited_member(edges: DataFrame, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(owner, name, id): the member that an owner has from its nearest ancestor. wanted: (owner, name); members: (owner, name, id)."""
    up = edges.where("relation = 'inherits'").select("source", "target").distinct()
    above = closure(wanted.select("owner"), up).where("distance > 0")
    found = wanted.join(above, F.col("owner") == F.col("start")).join(members.select(F.col("owner").alias("node"), "name", "id"), ["node", "name"])
    return found.groupBy("owner", "name").agg(F.min(F.struct("distance", "id")).alias("f")).select("owner", "name", F.col("f.id").alias("id"))
