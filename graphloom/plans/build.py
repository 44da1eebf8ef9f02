"""Building a graph from a source tree: reading, extraction, passes, confidence."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.traverse import cut
from graphloom.plans import postpass
from graphloom.sources import extract, flows, walk
from graphloom.sources.store import Graph


class OutOfTime(TimeoutError):
    """The time budget of a report or build ran out."""


@contextmanager
def budget(spark: SparkSession, seconds: float, group: str = "graphloom"):
    """Cancels the jobs started inside after so many seconds (0: never)."""
    if not seconds:
        yield
        return
    sc, late = spark.sparkContext, threading.Event()
    sc.setJobGroup(group, group, interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: (late.set(), sc.cancelJobGroup(group)))
    timer.start()
    try:
        yield
    except Exception as error:
        if late.is_set():
            raise OutOfTime(f"{group}: more than {seconds} s") from error
        raise
    finally:
        timer.cancel()


#: Parts in which files are extracted, in the order of priority, where a time budget is set.
PARTS = 8


def build(spark: SparkSession, root: str, out: str, language: str = "", include_research: bool = False, max_files: int = 0, max_failures: int = 5, sarif: str = "", timeout: float = 0) -> dict:
    """Reads the tree at root, writes its graph to out and tells what was done.

    max_files keeps the files that matter most; a language keeps its files only. When the time budget is spent, the
    graph of the files extracted until then is written and the status is partial; if there are none, OutOfTime.
    """
    ends = time.monotonic() + timeout
    with budget(spark, timeout, "build"):
        files = walk.read_tree(spark, root, include_research)
        wanted = files.where("reason = ''")
        if language:
            wanted = wanted.where(F.col("language") == language)
        by_files = wanted.groupBy("language").count().orderBy(F.desc("count"), "language").collect()
        order = cut(walk.numbered(wanted, language or (by_files[0][0] if by_files else "")))
    considered = sum(r[1] for r in by_files)
    total = min(considered, max_files) if max_files else considered
    step = max(1, -(-total // PARTS)) if timeout else max(1, total)
    parts, indexed = [], 0
    while indexed < total:
        mine = order.where((F.col("number") >= indexed) & (F.col("number") < min(total, indexed + step))).select("path")
        try:
            with budget(spark, max(0.001, ends - time.monotonic()) if timeout else 0, "build"):
                parts.append(extract.stored_rows(wanted.join(mine, "path", "left_semi")))
        except OutOfTime:
            if not parts:
                raise
            break
        indexed = min(total, indexed + step)
    rows = reduce(DataFrame.union, parts) if parts else extract.extracted(wanted.where("false"))
    graph, failed = extract.graph_of(rows, order)
    graph = postpass.annotate(graph)
    unresolved = 0
    if sarif:
        new, lost = flows.flow_edges(flows.read_sarif(spark, sarif, root), graph.nodes)
        graph.edges = graph.edges.unionByName(new.withColumn("seq", F.lit(1 << 60)))
        unresolved = lost.count()
    failures = [r.asDict() for r in (failed.orderBy("path").limit(max_failures) if max_failures else failed.orderBy("path")).collect()]
    n_failed = failed.count()
    done = wanted.select("path", "language").join(order.where(F.col("number") < indexed), "path")
    graph.facts = {
        "built_at": datetime.now(timezone.utc).isoformat(), "root": root, "languages": {r[0]: r[1] for r in done.groupBy("language").count().orderBy("language").collect()}, "files": indexed,
        "confidence": postpass.confidence(considered, indexed - n_failed, indexed, n_failed),
    }
    graph.save(out)
    status = "partial" if indexed < considered else "success"
    return {"status": status, "considered": considered, "indexed": indexed, "failures": failures, "failure_count": n_failed, "unresolved_flows": unresolved} | graph.facts
