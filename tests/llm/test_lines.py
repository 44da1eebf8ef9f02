import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, lines, setjoin
from tests.llm.helpers import SF, WORDS, empty_docs, odd_docs, texts


def brute(docs):
    """(doc_id, text, number of the line, its set of words), of lines with a word."""
    found = []
    for i, t in dict.fromkeys((i, t) for i, t in docs if t is not None):
        for k, line in enumerate(t.split("\n")):
            if w := WORDS.findall(line):
                found.append((i, t, k, frozenset(w)))
    return found


def gone(found, order):
    """The lines whose words are like those of an earlier line; found by words of the rarest fifth, else by all."""
    found = sorted(found, key=lambda f: (*order(f[0], f[1]), f[2]))
    often = Counter(x for f in found for x in f[3])
    by_word, first, out = {}, {}, set()
    for n, (i, t, k, s) in enumerate(found):
        if s in first:
            out.add((i, t, k))
            continue
        first[s] = n
        words = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1]
        if any(len(s & found[m][3]) * 5 >= 4 * len(s | found[m][3]) for m in {m for x in words for m in by_word.get(x, ())}):
            out.add((i, t, k))
        for x in words:
            by_word.setdefault(x, []).append(n)
    return out


def check(spark, docs):
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    hashes = {r[0]: r[1] for r in docs.selectExpr("text", "xxhash64(text)").collect()}
    want = gone(brute(plain), lambda i, t: (i is None, i or 0, hashes[t]))
    got = lines.count_removed(docs).collect()
    assert len(got) == len(plain)
    expected = sorted((-1 if i is None else i, len(t.split("\n")) if t is not None else 0, ",".join(str(k) for k in range(len((t or "").split("\n"))) if (i, t, k) in want)) for i, t in plain)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.removed) for r in got) == expected
    assert all(r.n_removed == (r.removed.count(",") + 1 if r.removed else 0) for r in got)
    return want


def test_whole_table(spark):
    assert len(check(spark, spark.read.parquet(f"{SF}/documents.parquet"))) > 100


SETTINGS = [{}, {"COMMON": 0, "GROUP": 3, "BROADCAST_ROWS": 0}, {"COMMON": 12, "GROUP": 64, "LONG": 12, "BROADCAST_ROWS": 0}]


def set_to(monkeypatch, settings):
    """Other bounds of what is rare, long, large or broadcast change no result."""
    for name, value in settings.items():
        for module in (lines, setjoin, common):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize("settings", SETTINGS)
def test_variants_of_lines_and_common_passages(spark, monkeypatch, settings):
    set_to(monkeypatch, settings)
    rng = random.Random(2)
    line = [f"w{i}" for i in range(40)]
    passage = " ".join(f"p{i}" for i in range(12))
    docs = []
    for i in range(60):
        own = list(line)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(40)] = f"x{rng.randrange(5)}"
        other = " ".join(f"y{rng.randrange(400)}" for _ in range(rng.randrange(5, 14)))
        docs.append((i, "\n".join([" ".join(own), f"{other} {passage}", "a b c", "same words in this line", "\t".join(own[:20])])))
    assert len(check(spark, spark.createDataFrame(docs, "doc_id long, text string"))) > 100


@pytest.mark.parametrize("settings", SETTINGS)
def test_edited_lines(spark, monkeypatch, settings):
    """One word changed in lines of any length; numbers differ, so no two are equal."""
    set_to(monkeypatch, settings)
    rng = random.Random(7)
    docs = []
    for i in range(150):
        own = [f"w{rng.randrange(60)}" for _ in range(rng.choice((3, 8, 9, 10, 30, 60)))]
        other = list(own)
        other[rng.randrange(len(own))] = f"x{i}"
        docs += [(2 * i, " ".join(own)), (2 * i + 1, "  ".join(other))]
    assert 60 < len(check(spark, spark.createDataFrame(docs, "doc_id long, text string"))) < 150


def test_numbered_lines(spark):
    """Five words of which one is a number: 4 of 6 are common, so all stay, whatever their hashes."""
    docs = spark.createDataFrame([(i, "\n".join(f"The quick report {i * 4000 + k} arrived" for k in range(4000))) for i in range(100)], "doc_id long, text string")
    assert lines.removed_lines(docs).count() == 0


@pytest.mark.parametrize("settings", SETTINGS)
def test_lines_like_those_of_repeated_rows(spark, monkeypatch, settings):
    set_to(monkeypatch, settings)
    rng = random.Random(5)
    docs = []
    for i in range(40):
        own = [f"w{k}" for k in range(40)]
        own[rng.randrange(40)] = f"x{i}"
        docs += [(i, " ".join(own))] * (1 + 2 * (i % 3 == 0))
    assert check(spark, spark.createDataFrame(docs, "doc_id long, text string"))


def test_repeats_of_short_lines_go(spark):
    docs = spark.createDataFrame([(1, "one two three four five\nshort\nA b c\n\n "), (2, "short\na b c\n short \nA\tb c\n\n "), (3, "short b\nshort\none two three four\none two three four five"), (4, None), (5, "")], "doc_id long, text string")
    first, second = (docs.collect()[k].text for k in (1, 2))
    assert check(spark, docs) == {(2, first, k) for k in (0, 2, 3)} | {(3, second, k) for k in (1, 2, 3)}


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "'a' AS gone", "'b' AS th", "'c' AS g", "'d' AS row", "4 AS __gone", "5 AS __of", "6 AS id")
    check(spark, docs)
    out = lines.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    other = [c for c in docs.columns if c != "text"]
    assert sorted(map(repr, out.select(other).collect())) == sorted(map(repr, docs.select(other).collect()))
    assert lines.count_removed(empty_docs(spark)).count() == 0


def test_lines_are_taken_out(spark):
    docs = spark.createDataFrame([(1, "one two three four five\nshort"), (2, "short\none two three four five\nother"), (3, "one two three four five"), (4, None)], "doc_id long, text string")
    assert [tuple(r) for r in lines.drop_lines(docs).orderBy("doc_id").collect()] == [(1, "one two three four five\nshort"), (2, "other"), (3, ""), (4, None)]


def test_counts_stay_out_of_the_rows(spark):
    """The array of classes is read where it is, never copied into rows."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    hashed = lines._hashed(lines._lines(docs))
    placed = hashed.withColumn("classes", lines._classes(hashed).scalar())
    plan = placed.select(lines._set_of(F.col("line"), F.col("classes")))._jdf.queryExecution().executedPlan().toString()
    assert "AS classes" not in plan


def test_tokens_are_made_once_and_sorted_in_generated_code(spark):
    """Nothing but the loops over words is left to lambdas, which run interpreted with all that they hold."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    placed = lines._lines(docs).withColumn("classes", lines._classes(docs.select(F.col("text").alias("line"))).scalar())
    sets = placed.select("at", lines._set_of(F.col("line"), F.col("classes")).alias("t")).select("at", *lines._entry(F.col("t")))
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(transform(") == 1 and "sort_array(t#" in plan and "AS classes" not in plan


@pytest.mark.parametrize("wide", [0, 12, 1000])
def test_signatures_of_either_width(spark, monkeypatch, wide):
    """Sets on both sides of the size from which signatures are wider meet."""
    set_to(monkeypatch, {"WIDE": wide})
    rng = random.Random(11)
    docs = []
    for i in range(120):
        own = [f"w{rng.randrange(90)}" for _ in range(rng.choice((10, 14, 16, 60, 130)))]
        other = [*own, *(f"x{i}y{k}" for k in range(rng.randrange(len(own) // 4 + 2)))]
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    assert 30 < len(check(spark, spark.createDataFrame(docs, "doc_id long, text string"))) < 120
