"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of 64 bit places gets a nonzero vector of r + 1 bits, r being the radius. For each nonzero vector v of as many
bits, a table keeps the places whose vector has odd inner product with v. Any r places have vectors that leave some
v orthogonal to all of them, so two fingerprints that differ in r places at most agree in some table: none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bits_of, checkpoint, has_bit, in_blocks, joinable, key_groups, local_roots
from graphloom.llm.components import connected_components
from graphloom.llm.setjoin import entries, later_sets, prefix

RADIUS = 3
BITS = 64
#: Fingerprints compared at once; larger buckets are dealt into blocks.
BUCKET = 1500


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if (v & (1 + i % vectors)).bit_count() % 2) for v in range(1, vectors + 1)]


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 with seed 42 of the shingles of `width` words, repeats included, A-Z lowered, many at a time; of all words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(joined, 42)], "<u8")
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-width] + 1)
    for at in range(0, len(starts), 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), ends[width - 1 :][at : at + (1 << 16)].tolist(), strict=True)
        yield np.fromiter((digest(joined[s:e], 42) for s, e in pairs), "<u8")


def _counted(hashes: list[np.ndarray]) -> int:
    """The unsigned fingerprint: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > sum(map(len, hashes)), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of a text; zero without words."""
    return _counted(list(shingle_hashes(text, width)))


def fingerprint(text: Column, width: int) -> Column:
    """A signed 64-bit fingerprint over shingles of `width` words; zero for a null text or one without words."""

    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint_of(t.as_py(), width)) for t in texts], pa.int64())

    return F.arrow_udf(judge, "bigint")(text)


def _link(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, lo, hi), t in key_groups(batches, ["mask", "key", "lo", "hi"]):
            if t.num_rows < 2:
                continue
            fp = np.sort(t.column("fp").to_numpy())
            near = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64)) <= radius
            root = local_roots(near)
            own = root != np.arange(len(fp))
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["a", "b"])

    return link


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all fingerprints within the radius, a spanning set of each bucket. fps: distinct values in fp."""
    keyed = fps.select(F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in covering_masks(radius)))).alias("mask", "key"), "fp")
    keys = ["mask", "key"]
    blocks = in_blocks(keyed, keys, "fp", limit)
    keys += ["lo", "hi"]
    return blocks.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link(radius), "a long, b long")


def group_fingerprints(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, group) for the distinct values of rows.fp: group is the same within a component of links."""
    fps = rows.select("fp").distinct()
    roots = connected_components(link_fingerprints(fps, radius), "a", "b")
    return fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("group"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Texts that are null or have no words have fingerprint zero and are linked like others. Equal fingerprints are
    compared once, however many documents have them. Rows with a null doc_id count as documents, but give no
    component their name (null if no other does). An empty table gives no rows.
    """
    rows = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")))
    groups = checkpoint(group_fingerprints(rows, radius))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups, "fp")
    named = least.groupBy("group").agg(F.min("least").alias("component_id")).join(groups, "group").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Documents that have a shingle, beyond which it counts as common.
COMMON = 64
#: Bits of the signature by which documents meet, and of the wide one at least, which has as many as the document has shingles, or up to twice as many.
WIDE = 1024
_SKETCH = "id long, th long, fp long, n int, narrow array<long>, wide array<long>, tokens array<long>"


def distinct_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted as signed numbers."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, width)]).view(np.int64))


def _parities(h: np.ndarray, bits: int) -> np.ndarray:
    """Parities of hashes in so many places, as longs: sets differ in as many elements at least as these in bits."""
    odd = np.bincount(h & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _sketch(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, th, text in zip(*batch.columns, strict=True):
                hashes = list(shingle_hashes(text.as_py(), width))
                own = np.unique(np.concatenate([np.zeros(0, "<u8"), *hashes]).view(np.int64))
                n = len(own)
                rows.append((doc_id.as_py(), th.as_py(), _signed(_counted(hashes)), n, _parities(own, WIDE), _parities(own, max(WIDE, 1 << (n - 1).bit_length())), own[: n - (4 * n + 4) // 5 + 2]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "th", "fp", "n", "narrow", "wide", "tokens"])

    return sketch


def _items(width: int):
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([distinct_hashes(t.as_py(), width) for t in batch.column(3)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], own], ["l", "id", "th", "items"])

    return items


def _apart(narrow: Column, wide: Column) -> Column:
    """Bits in which parities differ, the wide ones folded to as many places as the narrow ones."""

    def folded(i: Column) -> Column:
        return F.aggregate(F.sequence(i, F.size(wide) - 1, F.size(narrow)), F.get(narrow, i), lambda x, k: x.bitwiseXOR(F.get(wide, k)))

    each = F.transform(F.sequence(F.lit(0), F.size(narrow) - 1), lambda i: F.bit_count(folded(i)))
    return F.aggregate(each, F.lit(0), lambda n, x: n + x)


def _later(docs: DataFrame, sketches: DataFrame, width: int) -> DataFrame:
    """id and th of the documents of sketches whose set of shingles has a Jaccard similarity of 4/5 or more to that of an earlier one."""
    sets = sketches.where("n > 0").select(F.xxhash64("id", "th").alias("l"), F.col("id").alias("doc"), "id", "th", "n", *(F.get("narrow", F.lit(k)).alias(f"s{k}") for k in range(WIDE // 64)), "wide", "tokens")
    counts = sets.select(F.explode(F.slice("tokens", F.lit(1), prefix(F.col("n")))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    counts = checkpoint(counts.where("n > 1"))
    found, common = bits_of(counts, "tok"), bits_of(counts.where(F.col("n") > COMMON), "tok")
    rare, often = entries(sets, lambda t: has_bit(common, t), lambda t: ~has_bit(found, t))

    def known_of(ids: DataFrame) -> DataFrame:
        wanted = joinable(checkpoint(sets.join(joinable(ids), "l", "left_semi").select("l", "id", "th")))
        texts = docs.join(wanted, ["id", "th"]).select("l", "id", "th", "text")
        known = texts.mapInArrow(_items(width), "l long, id long, th long, items array<long>")
        return known.groupBy("l", F.struct("id", "th").alias("at")).agg(F.max("items").alias("items"))

    def screen(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("l").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
        apart = F.when(F.size("wide_a") <= F.size("wide_b"), _apart(F.col("wide_a"), F.col("wide_b"))).otherwise(_apart(F.col("wide_b"), F.col("wide_a")))
        return pairs.join(a, "a").join(b, "b").where(9 * apart <= F.col("n_a") + F.col("n_b")).select("a", "b").distinct()

    return later_sets(rare, often, known_of, lambda items: items, "at.id", screen).select("at.id", "at.th")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their component, one of them where rows repeat, all columns as they were.

    Of these, a row goes if an earlier one, gone or not, has a Jaccard similarity of 4/5 or more by distinct shingles of
    `width` words, A-Z lowered: an exact join (`setjoin`), as fingerprints of such texts may be far apart. A null
    doc_id counts as larger than any other; of unequal texts with one doc_id that with the smaller hash comes first.
    Texts without words are one component. An empty table stays empty.
    """
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"), F.struct("*").alias("row"))
    rows = checkpoint(keyed.select("id", "th", "text").mapInArrow(_sketch(width), _SKETCH))
    groups = group_fingerprints(rows, radius)
    each = rows.groupBy("fp", "id", "th").agg(F.count("*").alias("copies"))
    firsts = each.groupBy("fp").agg(F.min(F.struct("id", "th", "copies")).alias("first")).join(groups, "fp")
    firsts = checkpoint(firsts.groupBy("group").agg(F.min("first").alias("first")).select("first.*"))
    own = joinable(firsts.select("id", "th"))
    sketches = rows.join(own, ["id", "th"], "left_semi").groupBy("id", "th").agg(F.max(F.struct("n", "narrow", "wide", "tokens")).alias("s"))
    sketches = checkpoint(sketches.select("id", "th", "s.*"))
    gone = checkpoint(_later(keyed.select("id", "th", "text"), sketches, width))
    stay = firsts.join(joinable(gone), ["id", "th"], "left_anti")
    single, repeated = joinable(stay.where("copies = 1").select("id", "th")), stay.where("copies > 1").select("id", "th")
    kept = keyed.join(single, ["id", "th"], "left_semi")
    if not repeated.isEmpty():
        kept = kept.union(keyed.join(joinable(repeated), ["id", "th"], "left_semi").dropDuplicates(["id", "th"]))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
