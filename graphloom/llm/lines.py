"""Removal of repeated and nearly repeated lines by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct words, ordered by rarity: by how often a word is found in the whole corpus, then by
its hash. The counts are kept in a sketch of fixed size, so words that share a place in it count together; that moves
words in the order and changes no result. Lines whose Jaccard similarity is 4/5 or more are found as `setjoin` says and
verified on their words, and the later one goes. Lines that are equal, byte for byte, are merged before.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, joinable
from graphloom.llm.setjoin import entries, later_sets, prefix, signature

#: Places of the sketch of word counts (a power of two); its 4 MB are all that goes to every task.
PLACES = 1 << 22
#: A word's class is 4 times the binary logarithm of its count, 127 at most. Classes above this one (over some 1,000 times) are common.
COMMON = 40
#: What parts words, but for the line break.
SPACES = " \t\x0b\x0c\r"


def words_of(line: Column) -> Column:
    untidy = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in ("  ", *SPACES[1:]):
        untidy = untidy | F.contains(line, F.lit(c))
    plain = F.translate(line, SPACES[1:], " " * len(SPACES[1:]))
    return F.when(untidy, F.array_remove(F.split(plain, " "), "")).otherwise(F.split(line, " "))


def _lines(rows: DataFrame) -> DataFrame:
    """at (the place in the order of all lines) and line, of all lines that have a word."""
    each = rows.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "ln").alias("at")
    return each.where(F.ltrim("line", F.lit(SPACES)) != "").select(at, "line")


def _hashed(lines: DataFrame) -> DataFrame:
    """With l and l2, 128 bits of hash of the line."""
    return lines.select("at", "line", F.xxhash64("line").alias("l"), F.xxhash64(F.lit(7), "line").alias("l2"))


def _place(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(PLACES - 1)).cast("int")


def _classes(lines: DataFrame) -> DataFrame:
    """One row: an array with the class of each place, of the words of line, which may hold line breaks. Eight classes at a time travel in a long."""
    line = F.col("line")
    odd = reduce(or_, (F.contains(line, F.lit(c)) for c in SPACES[1:]))
    plain = F.when(odd, F.translate(line, SPACES[1:] + "\n", " " * len(SPACES))).otherwise(F.replace(line, F.lit("\n"), F.lit(" ")))
    words = lines.select(F.explode(F.split(plain, " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(_place(F.xxhash64("w")).alias("place")).agg(F.count("*").alias("n"))
    grade = F.least(F.floor(4 * F.log2(F.col("n").cast("double"))), F.lit(127)).cast("long")
    eight = F.shiftright("place", 3).alias("q")
    packed = counts.groupBy(eight).agg(F.bit_or(F.call_function("shiftleft", grade, F.shiftleft(F.col("place").bitwiseAND(7), 3))).alias("v"))
    every = lines.sparkSession.range(PLACES // 8).select(F.col("id").cast("int").alias("q")).join(packed, "q", "left")
    whole = every.agg(F.sort_array(F.collect_list(F.struct("q", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("a"))
    bits = F.array(*(F.lit(8 * k) for k in range(8)))
    return whole.select(F.flatten(F.transform("a", lambda x: F.transform(bits, lambda k: F.call_function("shiftright", x["v"], k).bitwiseAND(F.lit(127)).cast("tinyint")))))


def _class(token: Column) -> Column:
    return F.call_function("shiftright", token, F.lit(56))


def _set_of(line: Column, classes: Column) -> Column:
    """The tokens of a line, each once. A token: its class in 7 bits, then 56 bits of hash."""

    def token(h: Column) -> Column:
        rank = F.coalesce(F.get(classes, _place(h)), F.lit(0).cast("tinyint")).cast("long")
        return F.call_function("shiftleft", rank, F.lit(56)).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.array_distinct(F.transform(words_of(line), lambda w: token(F.xxhash64(w))))


def _entry(tokens: Column) -> list[Column]:
    """n, s0, odd and tokens, the prefix and one token more."""
    n = F.when(tokens.isNotNull(), F.size(tokens))
    s0, odd = signature(tokens, n)
    return [n.alias("n"), s0.alias("s0"), odd.alias("odd"), F.slice(F.sort_array(tokens), F.lit(1), prefix(n) + 1).alias("tokens")]


_LAST = (1 << 63) - 1


def _marked(lines: DataFrame, twice: DataFrame) -> DataFrame:
    """at, line, l, own (it is the first of its copies) and single (it has none)."""
    first = F.col("first")
    return _hashed(lines).join(twice, ["l", "l2"], "left").select("at", "line", "l", (first.isNull() | (F.col("at") == first)).alias("own"), first.isNull().alias("single"))


def _firsts(lines: DataFrame, twice: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, again): a row for each distinct line, with l, doc, n, s0, odd and tokens; at of the copies of earlier lines."""
    marked = _marked(lines, twice).withColumn("classes", classes.scalar())
    rows = marked.select("l", F.coalesce("at.doc_id", F.lit(_LAST)).alias("doc"), F.when(~F.col("single"), F.col("at")).alias("at"), F.when(F.col("own"), _set_of(F.col("line"), F.col("classes"))).alias("t"))
    rows = checkpoint(rows.select("l", "doc", "at", *_entry(F.col("t"))))
    # a first line is there as often as its row repeats
    once = checkpoint(rows.where("at is not null and n is not null").groupBy("l", "at").agg(F.max(F.struct("doc", "n", "s0", "odd", "tokens")).alias("s")).select("l", "s.*"))
    return rows.where("at is null").select(once.columns).union(once), rows.where("n is null").select("at")


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, ln): the lines that go, by document (its id and the hash of its text) and number from 0.

    A line goes if an earlier one in the order of doc_id (null last), hash of the text and number equals it, or has a
    set of words with a Jaccard similarity of 4/5 or more, be that one gone itself or not. Words are what spaces,
    tabs and the like part, as they are written. Lines without words stay. Repeated rows are one document. Null and
    empty texts have no lines; an empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines, classes = _lines(docs), _classes(docs.select(F.col("text").alias("line")))
    twice = _hashed(lines).groupBy("l", "l2").agg(F.min("at").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    twice = joinable(checkpoint(twice.select("l", "l2", "first")))

    def known_of(ids: DataFrame) -> DataFrame:
        wanted = lines.withColumn("l", F.xxhash64("line")).join(joinable(ids), "l", "left_semi").select("at", "line")
        return _marked(wanted, twice).where("own").groupBy("l", "at").agg(F.max("line").alias("items"))

    sets, again = _firsts(lines, twice, classes)
    rare, often = entries(sets, lambda t: _class(t) > COMMON, lambda t: _class(t) == 0)
    near = later_sets(rare, often, known_of, words_of, f"coalesce(at.doc_id, {_LAST})")
    return near.union(again).distinct().select("at.doc_id", "at.th", "at.ln")


def _per_document(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    gone = removed_lines(docs, doc_id, text)
    return gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("ln")).alias("gone")).alias("g")


def _of(row: DataFrame, gone: DataFrame) -> DataFrame:
    return row.alias("d").join(gone, F.col("d.id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.th") == F.col("g.th")), "left")


def count_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed, removed (the numbers of the lines, comma-joined)."""
    breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    n = F.when(F.col(text).isNull(), 0).otherwise(breaks + 1).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("th"), n.alias("n_lines"))
    gone = F.col("g.gone")
    numbers = F.array_join(F.transform(gone, lambda x: x.cast("string")), ",")
    return _of(rows, _per_document(docs, doc_id, text)).select("d.doc_id", "n_lines", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(numbers, F.lit("")).alias("removed"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines that go taken out of the text, all other columns as they were. A null text stays null."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.struct("*").alias("row"))
    joined = _of(rows, _per_document(docs, doc_id, text))
    left = F.array_join(F.filter(F.split(F.col("row")[text], "\n"), lambda x, i: ~F.array_contains(F.col("g.gone"), i)), "\n")
    kept = F.when(F.col("g.gone").isNull(), F.col("row")[text]).otherwise(left)
    return joined.select(*(kept.alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
