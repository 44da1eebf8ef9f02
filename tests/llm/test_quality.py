import re
from collections import Counter

from graphloom.llm import quality
from graphloom.llm.queries import op2_quality_rules
from tests.llm.helpers import SF, WORDS, empty_docs, odd_docs, texts


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


def test_base_columns_against_brute_force(spark):
    got = {r[0]: tuple(r)[1:7] for r in op2_quality_rules(spark, SF).collect()}
    assert got == {i: base(t) for i, t in texts(spark)}


def test_verdicts_follow_the_labels(spark):
    rows = spark.read.parquet(f"{SF}/labels.parquet").join(op2_quality_rules(spark, SF), "doc_id").select("quality", "kept", "base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_long_texts_use_the_same_rule(monkeypatch):
    text = ("a b c d e f g " * 3 + " ".join(f"u{i}" for i in range(40)) + " a b c d e").encode().split()
    plain = quality._repeat_words(text)
    monkeypatch.setattr(quality, "_LONG", 5)
    assert quality._repeat_words(text) == plain == base(b" ".join(text).decode())[4]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = quality.annotate(docs, out="verdict")
    assert got.drop("verdict").columns == docs.columns
    rows = got.select("text", "verdict").collect()
    assert len(rows) == docs.count()
    assert all(tuple(r.verdict)[:5] == base(r.text)[:5] and r.verdict.base_failed == base(r.text)[5] for r in rows)
    clash = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'own' AS f", "7 AS __features", "8 AS __quality", "9 AS row", "10 AS verdict")
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns and {tuple(r)[-4:] for r in kept.collect()} == {(7, 8, 9, 10)}
    assert {tuple(r) for r in quality.annotate(clash).select("f", "__features", "row", "verdict").collect()} == {("own", 7, 9, 10)}
    assert quality.annotate(empty_docs(spark)).count() == 0


def test_em_separates_two_kinds():
    prior, odds = quality.fit({(1, 1, 0): 900, (-1, 0, 0): 40, (0, -1, -1): 60}, 3)
    assert prior > 0 and odds[0, 0] < 0 < odds[0, 2] and odds[1, 0] < 0
