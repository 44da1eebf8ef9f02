"""Exact set-similarity join, in DataFrame functions only: sets whose Jaccard similarity to an earlier one is 4/5 or more.

The tokens of every set are in one global order. Of sets of na and nb tokens that are alike, 4 (na + nb) / 9 tokens at
least are common, so they share a token in the first fifth (and one) of either: its prefix. A token of the prefix is a
key by which sets meet. Where a token is common, a key is that token with each later one of the prefix and one token
more: of sets alike, the first two common tokens lie there. So few sets meet at a key, however large the corpus. Sets
of over LONG tokens would have too many such keys and meet by single tokens; those near that bound do both.

Sets that meet pass the length filter, the positional filter and a bound from signatures before they are verified.
Keys at which over GROUP sets meet are large groups of sets alike, or chance. There the smaller set of a pair stands
under its size and the larger looks under all sizes that its position allows; all are compared with the first one
under a key and size, and only those that are not found to be like an earlier one with the others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, joinable

#: Sets at a key beyond which they are compared by size, and with the first one before others.
GROUP = 64
#: Tokens in a set from which on a single common token is a key.
LONG = 100
#: nm is n, the size of the set, and the size of the largest set that may be like it by the place of the key in it, in one number.
ENTRY = ("key", "l", "nm")
#: Tokens in a set beyond which its signature has 128 bits.
WIDE = 100
#: Sizes up to this one stand for themselves, larger ones in classes, each 1.05 times the one before.
EXACT_SIZES = 32


def prefix(n: Column) -> Column:
    """n - ceil(4 n / 5) + 1, in whole numbers."""
    return (n - F.floor((4 * n + 4) / 5) + 1).cast("int")


def signature(tokens: Column, n: Column) -> tuple[Column, Column]:
    """s0 and odd: parities of tokens by their lowest bits in 64 places; of sets of over WIDE tokens, the share in s0 of tokens with the next bit too.

    Two sets differ in as many tokens at least as their signatures in bits.
    """

    def parities(bit: Callable[[Column], Column]) -> Column:
        return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", bit(x), x.bitwiseAND(F.lit(63)).cast("int"))))

    one = F.lit(1).cast("long")
    return parities(lambda _: one), F.when(n > WIDE, parities(lambda x: F.call_function("shiftright", x, F.lit(6)).bitwiseAND(one))).otherwise(F.lit(0).cast("long"))


def entries(sets: DataFrame, common: Callable[[Column], Column], useless: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The keys of sets by rare tokens, and those by common ones.

    sets: l (id), doc (a long by which sets go roughly in order), n (size), s0, s1 and so on, a signature in as many
    longs as sets of that kind need, or s0 and odd, see signature(), and tokens, the first prefix(n) + 1 tokens; the first of these may be left out if no other set has them. common(token) tells which are common,
    useless(token) which no two sets share.
    """
    entry = (*ENTRY[1:], *_signature(sets))
    named = sets.withColumn("p", prefix(F.col("n"))).withColumn("left_out", F.least("n", F.col("p") + 1) - F.size("tokens"))
    each = named.select("*", F.posexplode("tokens").alias("at_token", "tok")).withColumn("i", F.col("at_token") + F.col("left_out")).where(F.col("i") < F.col("p"))
    each = each.withColumn("nm", _sizes(F.col("n"), F.col("i")))
    tok = F.col("tok")
    alone = ~common(tok) if useless is None else ~common(tok) & ~useless(tok)
    rare = each.where(alone).select(tok.alias("key"), *entry)
    often = each.where(common(tok))
    single = often.where((F.col("n") == 1) | (5 * F.col("n") >= 4 * LONG)).select(tok.alias("key"), *entry, "doc")
    double = often.where((F.col("n") > 1) & (F.col("n") <= LONG)).select("*", F.posexplode(F.slice("tokens", F.col("at_token") + 2, F.size("tokens"))).alias("k", "next"))
    # with the second common token where it is, one token before it is common
    double = double.withColumn("nm", _sizes(F.col("n"), F.col("i") + F.col("k"))).select(F.xxhash64("tok", "next").alias("key"), *entry, "doc")
    return rare, single.union(double)


def _sizes(n: Column, i: Column) -> Column:
    """nm, by the length filter and the positional filter for the first common token: a set of m tokens may be alike if 4 m <= 5 n and 4 (n + m) <= 9 (n - i)."""
    most = F.least(F.floor(5 * n / 4), F.floor(9 * (n - i) / 4) - n).cast("long")
    return F.shiftleft(n.cast("long"), 32).bitwiseOR(most)


def _n_and_most(nm: Column) -> tuple[Column, Column]:
    return F.shiftright(nm, 32), nm.bitwiseAND(F.lit((1 << 32) - 1))


def _signature(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.fullmatch(r"s\d+|odd", c)]


def _fits(a: str, b: str, signature: list[str]) -> Column:
    """Each is no larger than the other allows, and the bound that signatures give."""
    (na, most_a), (nb, most_b) = _n_and_most(F.col(f"{a}.nm")), _n_and_most(F.col(f"{b}.nm"))
    differ = {s: F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")) for s in signature}
    odd = differ.pop("odd", None)
    near = 9 * reduce(add, map(F.bit_count, differ.values())) <= na + nb
    if odd is not None:
        near = near & ((na <= WIDE) | (nb <= WIDE) | (9 * (F.bit_count(odd) + F.bit_count(odd.bitwiseXOR(differ["s0"]))) <= na + nb))
    return (nb <= most_a) & (na <= most_b) & near


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _all_pairs(at_keys: DataFrame) -> DataFrame:
    x, y = at_keys.alias("x"), at_keys.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.l") < F.col("y.l")) & _fits("x", "y", _signature(at_keys))).select(F.col("x.l").alias("a"), F.col("y.l").alias("b"))


def _size_class(n: Column) -> Column:
    return F.when(n < EXACT_SIZES, n).otherwise(EXACT_SIZES + F.floor(F.log(n / F.lit(float(EXACT_SIZES))) / math.log(1.05)).cast("int"))


def _by_size(many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stands, looks): entries under the class of their own size, if a set of that size or more may be like them, and under those of the sizes that are no larger."""
    n, most = (x.cast("int") for x in _n_and_most(F.col("nm")))
    stands = many.where(most >= n).withColumn("size", _size_class(n))
    least, most = F.floor((4 * n + 4) / 5).cast("int"), F.least(n, most)
    return stands, many.where(least <= most).withColumn("size", F.explode(F.sequence(_size_class(least), _size_class(most))))


def _meet(x: DataFrame, y: DataFrame) -> DataFrame:
    signature = _signature(x)
    x, y = x.alias("x"), y.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.l") != F.col("y.l"))
    return x.join(y, same & _fits("x", "y", signature)).select(*_pair(F.col("x.l"), F.col("y.l")))


def _with_first(many: DataFrame) -> DataFrame:
    """Pairs of each set and the first one under its keys and sizes: linear, however large the group."""
    stands, looks = _by_size(many)
    first = stands.groupBy("key", "size").agg(F.min(F.struct("doc", "l", "nm", *_signature(many))).alias("y")).select("key", "size", "y.*")
    return _meet(looks, first)


def _with_others(many: DataFrame, gone: DataFrame) -> DataFrame:
    """Pairs under a key and size of which one is not gone; skewed groups are split by the join."""
    gone = joinable(gone.select("l", "doc", F.lit(True).alias("out")).distinct())
    stands, looks = _by_size(many.join(gone, ["l", "doc"], "left").withColumn("open", F.col("out").isNull()))
    return _meet(looks.where("open"), stands).union(_meet(looks.where("not open"), stands.where("open")))


def _later(pairs: DataFrame, known: DataFrame, elements: Callable[[Column], Column]) -> DataFrame:
    """(l, at) of the later sets of pairs that are alike. known: l, at and items, of which elements() makes the whole sets, repeats included."""
    known = checkpoint(known.withColumn("size", F.size(F.array_distinct(elements(F.col("items"))))))
    a, b = (known.select(F.col("l").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("at", "items", "size"))) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").where(F.col("at_a") != F.col("at_b"))
    common = F.size(F.array_intersect(elements(F.col("items_a")), elements(F.col("items_b"))))
    alike = both.where(9 * common >= 4 * (F.col("size_a") + F.col("size_b")))
    later = F.when(F.col("at_a") > F.col("at_b"), F.struct(F.col("a").alias("l"), F.col("at_a").alias("at"))).otherwise(F.struct(F.col("b").alias("l"), F.col("at_b").alias("at")))
    return alike.select(later.alias("x")).select("x.*").distinct()


def later_sets(rare: DataFrame, often: DataFrame, known_of: Callable[[DataFrame], DataFrame], elements: Callable[[Column], Column], doc: str, screen: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """at of the sets that an earlier one, gone itself or not, is like.

    rare, often: see entries(). known_of(ids), ids being a table of l, gives l, at (an order that tells sets apart)
    and items of these sets, of which elements() makes the array of their elements, repeats included; two sets of one id are both given
    and compared. doc: an expression of at, what entries have as doc. screen(pairs) may leave out pairs (a, b) of ids
    whose sets can't be alike, before items are fetched.
    """
    counts = checkpoint(often.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    few = often.join(joinable(counts.where(F.col("m") <= GROUP).select("key")), "key", "left_semi")
    pairs = _all_pairs(rare).union(_all_pairs(few.drop("doc")))
    large = counts.where(F.col("m") > GROUP).select("key")
    any_large = not large.isEmpty()
    if any_large:
        many = checkpoint(often.join(joinable(large), "key", "left_semi"))
        pairs = pairs.union(_with_first(many))
    pairs = checkpoint(screen(pairs.distinct()))
    gone = _later(pairs, known_of(_members(pairs)), elements)
    if any_large:
        gone = checkpoint(gone)
        rest = checkpoint(screen(_with_others(many, gone.select("l", F.expr(doc).alias("doc"))).distinct()))
        if not rest.isEmpty():
            gone = gone.union(_later(rest, known_of(_members(rest)), elements))
    return gone.select("at").distinct()


def _members(pairs: DataFrame) -> DataFrame:
    return checkpoint(pairs.select(F.col("a").alias("l")).union(pairs.select("b")).distinct())
