"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; an unseen word by the character n-grams it is made of, the
longest length of which any is known, down to single characters: by the mean of their log frequencies.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
#: The classifier is fit on so many labelled documents at most, the first by a hash of id and text; repeated rows count once.
SAMPLE = 6000
UNSEEN = 0.1
CACHE = 200_000
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w, n in Counter(words_of(text)).items():
                counts[lang, 0, w] += n
                for order in ORDERS:
                    for i in range(len(w) + 2 - order + 1) if order > 1 else range(1, len(w) + 1):
                        counts[lang, order, f"^{w}$"[i : i + order]] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in counts], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))] + [pa.array(list(counts.values()), pa.int64())], ["lang", "kind", "gram", "n"])


class Model:
    """Log frequencies by language. entries: (lang, kind, gram, n), kind 0 for words, else the length of the n-gram."""

    def __init__(self, entries: list[tuple[str, int, str, int]]):
        self.langs = sorted({e[0] for e in entries})
        at = {lang: i for i, lang in enumerate(self.langs)}
        counts: dict[int, dict[str, np.ndarray]] = {k: {} for k in (0, *ORDERS)}
        for lang, kind, gram, n in entries:
            counts[kind].setdefault(gram, np.zeros(len(at)))[at[lang]] += n
        self.known: dict[int, dict[str, np.ndarray]] = {}
        for kind, grams in counts.items():
            total = sum(grams.values(), np.zeros(len(at))) + UNSEEN * max(1, len(grams))
            self.known[kind] = {g: np.log((c + UNSEEN) / total) for g, c in grams.items()}

    def word(self, w: str) -> np.ndarray:
        """Scores by language: of the word, else of its longest known n-grams, their mean."""
        if (found := self.known[0].get(w)) is not None:
            return found
        for order in ORDERS:
            marked = f"^{w}$" if order > 1 else w
            grams = [g for i in range(len(marked) - order + 1) if (g := self.known[order].get(marked[i : i + order])) is not None]
            if grams:
                return np.mean(grams, axis=0)
        return np.zeros(len(self.langs))


class Predictor:
    """Scores of words are kept as rows of a matrix, so a text takes one gather and one product."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.zeros((1024, len(model.langs)))

    def _row(self, word: str) -> int:
        i = self.at[word] = len(self.at)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = self.model.word(word)
        return i

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        if len(self.at) > CACHE:
            self.at = {}
        counts, known = Counter(words), self.at
        at = [i if (i := known.get(w)) is not None else self._row(w) for w in counts]
        total = np.fromiter(counts.values(), np.float64, len(counts)) @ self.rows[at]
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from text and lang of rows that are not held out and have both."""
    rows = docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    last = rows.select("key").distinct().orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    if last is None:
        return Model([])
    used = rows.where(F.col("key") <= F.lit(last)).dropDuplicates(["key"]).select("lang", "text")
    counts = used.mapInArrow(_count, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.collect()])


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "predicted") -> DataFrame:
    """docs with a struct column `out`: lang_pred and score, the posterior probability of the language.

    A text that is null or has no letter is `und` with score 0; so is any if nothing could be learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    held: dict[str, Predictor] = {}

    def judge(texts: pa.Array) -> pa.Array:
        if "p" not in held:
            held["p"] = Predictor(shared.value)
        return pa.array([dict(zip(("lang_pred", "score"), held["p"](t), strict=True)) for t in texts.to_pylist()], kind)

    return docs.withColumn(out, F.arrow_udf(judge, "lang_pred string, score double")(F.col(text)))
