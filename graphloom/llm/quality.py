"""Quality rules as weak supervision.

Rules vote that a text is good (1) or bad (-1), or abstain (0). Expectation-maximisation over the counts of vote
patterns, which number 3 to the power of the rules at most whatever the corpus, estimates how each rule votes on
good and on bad texts; a text is kept if its posterior probability to be good is at least one half.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
#: Beyond so many words, windows are compared as numbers, for memory.
_LONG = 20_000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim"]


def _repeat_words(words: list[bytes], width: int = 5) -> int:
    n = len(words)
    if n <= width:
        return 0
    if n <= _LONG:
        windows = list(zip(*(words[i : n - width + 1 + i] for i in range(width)), strict=True))
        if len(first := dict.fromkeys(windows)) == len(windows):
            return 0
        counts = dict.fromkeys(first, 0)
        for w in windows:
            counts[w] += 1
        twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    else:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        key = ids[: n - width + 1]
        for i in range(1, width):
            key = np.unique(key * len(known) + ids[i : n - width + 1 + i], return_inverse=True)[1]
        twice = (np.bincount(key) > 1)[key]
    covered = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """FEATURES of one text."""
    if not text:
        return (0,) * len(FEATURES)
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    letters = data.translate(None, _NOT_LETTERS)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        len(data) - len(data.translate(None, _UPPER)),
        len(letters.decode()),
        text.count("!"),
    )


_TYPE = pa.struct([(x, pa.int64()) for x in FEATURES])


def _features(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(FEATURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(FEATURES))], fields=list(_TYPE))


def features(text: Column) -> Column:
    """A struct of FEATURES."""
    return F.arrow_udf(_features, ", ".join(f"{x} bigint" for x in FEATURES))(text)


def votes(f: str = "f") -> dict[str, Column]:
    """Each rule's vote from the struct of features named f."""

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    c = {x: F.col(f"{f}.{x}").cast("double") for x in FEATURES}
    words, chars = c["n_words"], c["word_chars"]
    return {
        "length": rule(words < 10, words >= 50),
        "symbols": rule(c["n_symbols"] > 0.2 * words, c["n_symbols"] <= 0.02 * words),
        "symbol_chars": rule(c["n_symbols"] > 0.03 * chars, c["n_symbols"] <= 0.002 * chars),
        "letters": rule(c["n_letters"] < 0.75 * chars, c["n_letters"] >= 0.92 * chars),
        "shouting": rule(c["n_upper"] > 0.4 * c["n_letters"], c["n_upper"] <= 0.1 * c["n_letters"]),
        "exclaim": rule(c["n_exclaim"] > 0.2 * words, c["n_exclaim"] <= 0.02 * words),
        "repeats": rule(c["n_repeat_words"] > 0.15 * words, c["n_repeat_words"] <= 0.02 * words),
        "lines": rule(c["n_dup_lines"] > 0.3 * c["n_lines"], c["n_dup_lines"] == 0),
        "word_length": rule((chars > 14 * words) | (chars < 2 * words), (chars >= 3 * words) & (chars <= 10 * words)),
    }


def fit(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(log-odds of good before any vote, log-odds [rule, vote + 1] of good given the vote), by expectation-maximisation.

    It starts from the belief that a text with any vote against it is bad. Counts get one pseudo-vote each, so
    that no vote rules a class out. No patterns: zeros.
    """
    if not patterns:
        return 0.0, np.zeros((n_rules, 3))
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    seen = np.array(keys, int).reshape(len(keys), n_rules) + 1
    good = np.where((seen == 0).any(1), 0.1, 0.9)
    prior, odds = 0.0, np.zeros((n_rules, 3))
    for _ in range(rounds):
        share = np.ones((2, n_rules, 3))
        for cls, p in enumerate((1 - good, good)):
            for j in range(n_rules):
                np.add.at(share[cls, j], seen[:, j], weight * p)
        share /= share.sum(2, keepdims=True)
        n_good = (weight * good).sum()
        prior = math.log((n_good + 1) / (weight.sum() - n_good + 1))
        odds = np.log(share[1] / share[0])
        logit = prior + odds[np.arange(n_rules), seen].sum(1)
        new = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return prior, odds


def annotate(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """docs with a struct column `out`: the features, base_failed, p_good and kept.

    A null or empty text has no words, so it fails the base rule. Each row is judged by itself, so repeated rows
    and extra columns are unaffected; an empty table stays empty. Texts are read twice: once for the counts of
    patterns over all rows, once for the verdicts. A column of docs named as `out` gives way; all others are
    as they were.
    """
    judged = _judge(docs, text)
    return judged.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != out), F.col("verdict").alias(out))


def _judge(docs: DataFrame, text: str) -> DataFrame:
    """row, the whole input row as a struct, and verdict."""
    f = "f"
    rules = votes(f)
    counted = docs.select(features(F.col(text)).alias(f)).groupBy(*(v.alias(k) for k, v in rules.items())).count().collect()
    prior, odds = fit({tuple(r[:-1]): r[-1] for r in counted}, len(rules))
    weigh = (F.when(v == -1, float(odds[j, 0])).when(v == 1, float(odds[j, 2])).otherwise(float(odds[j, 1])) for j, v in enumerate(rules.values()))
    logit = reduce(lambda a, b: a + b, weigh, F.lit(float(prior)))
    failed = (F.col(f"{f}.n_words") < 10) | (100 * F.col(f"{f}.n_repeat_words") > 20 * F.col(f"{f}.n_words"))
    p_good = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0))))
    columns = [F.col(f"{f}.{x}").alias(x) for x in FEATURES]
    verdict = F.struct(*columns, failed.alias("base_failed"), p_good.alias("p_good"), (~failed & (p_good >= 0.5)).alias("kept"))
    return docs.select(F.struct("*").alias("row"), features(F.col(text)).alias(f)).select("row", verdict.alias("verdict"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns as they were."""
    return _judge(docs, text).where("verdict.kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))
