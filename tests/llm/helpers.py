"""Plain versions of what the operators compute."""

import hashlib
import re

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def components(nodes, links):
    """{node: smallest node reachable}."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def texts(spark, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def odd_docs(spark):
    """Nulls, empty and long texts, ties and repeated rows, and a column with a clashing name."""
    long = " ".join(f"w{i % 7000}x{i}" for i in range(60_000))
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n", "en", None, 3), (4, long, "en", "b", len(long)), (5, "One two three four five. " * 30, "en", "b", 1), (5, "One two three four five. " * 30, "en", "b", 1)]
    rows += [(6, "One two three four five. " * 30, "en", "b", 1), (None, "no id here at all, my friend, none", "en", "b", 1), (7, "é\U0001f600 x" * 40, None, None, None), (8, "ab", "en", "c", 2), (8, "another text by the same id", "en", "c", 2)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'own' AS f", "1 AS quality", "2 AS fp", "3 AS `__id`")


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
