"""Operator 7: near-duplicate documents by b-bit MinHash.

1. Each whole text becomes its set of word shingles, as 64-bit hashes, and K minima of
   them. The minima's low BITS bits are packed into a signature; ROWS minima at a time make
   a band key.
2. Documents with equal sets are one class, named by its smallest id; from here on only
   classes are compared.
3. In each bucket (band key) every class meets the bucket's smallest one. Of the pairs that
   the signatures' bit counts, corrected for chance collisions, do not rule out, each class
   keeps its smallest partner, and the link is confirmed on the full sets.
4. What is still to find joins two components. Buckets that hold one component are done. In
   the others, PIVOT_ROUNDS times, every class meets one pivot of the bucket, drawn anew, and
   the likeliest link of each is confirmed; that connects groups of near copies.
5. What is left are buckets with classes that seem unlinked. There every two classes of
   different components are compared inside the join, which gives only the links: by size
   and signature, in the first bucket only that both are in, and then on the full sets. So
   none is lost, and neither the pairs of a group of near copies nor those that fail are
   ever made into rows.

A bucket may hold a third of all classes. Its rows are dealt to cells of about CELL rows; a
pivot is handed to each cell, and the comparisons of step 5 are dealt by pairs of cells, so
that no task gets a whole bucket.

Links and components stay in DataFrames throughout; components spread by smallest labels
with pointer jumping. Each step is written to the shared folder, and the files of a step
that a later one replaces are deleted.

With ROWS minima a band and the bands computed from the threshold, a pair at the threshold
misses all buckets with a probability of at most MISS, and one above it with less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.common import discard, slices, staged, table

ROWS = 5
MISS = 1e-6
#: Low bits kept of a minimum, and minima that go into the signature (8 words of 64 bits).
BITS = 4
LANES = 128
#: Rounds in which the classes of an open bucket meet a pivot.
PIVOT_ROUNDS = 3
#: Rows of a bucket that one task gets at least, about.
CELL = 512
#: Standard deviations by which an estimate may fall short of the threshold and still be confirmed.
SLACK = 6
#: Ids up to which the list of classes whose sets are needed may be broadcast (16 bytes each); else it is joined by a shuffle.
BROADCAST_IDS = 500_000

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_SIGNATURE = [f"s{k}" for k in range(LANES * BITS // 64)]


def bands_for(percent: int) -> int:
    """Bands that a pair of this similarity misses with a probability of at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLIER
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, no word none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    length = min(words, len(each))
    n = len(each) - length + 1
    joined = mixed(each[:n] + np.uint64(length))
    for k in range(1, length):
        joined = mixed(joined + each[k : k + n])
    return np.unique(joined)


class Minima:
    """K minima of a set under fixed hash functions, as band keys and packed signature."""

    def __init__(self, percent: int) -> None:
        self.bands = bands_for(percent)
        rng = np.random.default_rng(7)
        self.factors = rng.integers(0, 1 << 63, self.bands * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.terms = rng.integers(0, 1 << 63, self.bands * ROWS, np.uint64)[:, None] * np.uint64(2)

    def of(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(items), 4096):
            np.minimum(least, (self.factors * items[start : start + 4096] + self.terms).min(axis=1), out=least)
        keys = np.arange(self.bands, dtype=np.uint64)
        for column in least.reshape(self.bands, ROWS).T:
            keys = mixed(keys + column)
        lanes = np.zeros(LANES, np.uint8)
        kept = least[:LANES]
        lanes[: len(kept)] = mixed(kept) & np.uint64((1 << BITS) - 1)
        packed = (lanes[0::2] | lanes[1::2] << BITS).astype(np.uint8)
        return keys, packed.view("<u8")


def features(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets, null for the empty one), bands, signature words."""
    minima = Minima(percent)
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{s} long" for s in _SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, keys, bands, signatures = [], [], [], []
                for text in part.column("text").to_pylist():
                    items = shingles(text, words)
                    band, signature = minima.of(items)
                    counts.append(len(items))
                    keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                    bands.append(band.view(np.int64))
                    signatures.append(signature.view(np.int64))
                arrays = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                arrays += [pa.array(column, pa.int64()) for column in np.array(signatures).T]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "bands", *_SIGNATURE])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def full_sets(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id and its whole set as an array of long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, words).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "items"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, items array<long>")


def estimate(minima: int) -> Column:
    """Similarity of the classes behind columns a_s0.. and b_s0.., corrected for equal low bits by chance."""
    lanes = min(LANES, minima)
    ones = F.lit(0x1111111111111111)
    differ = F.lit(0)
    for s in _SIGNATURE:
        x = F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(lanes))) - chance) / (1 - chance)


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of the links (a, b)."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        better = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        better = staged(better, roots)
        jumped = better.join(better.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
        roots = staged(jumped.select("node", F.least("root", "next").alias("root"), "old"), better)
        if roots.where("root <> old").isEmpty():
            discard(both)
            return roots


def without_ids(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id is not in ``gone`` (one column of distinct ids); rows with a null id stay."""
    gone = staged(gone)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return df.join(gone, id_col, "left_anti")


def renamed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))


def classes_with_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable over links, kept says whether it is the
    row's own. A null or wordless text is linked with nothing. A row without an id takes
    no part: its component_id is null and it is kept. Repeated rows all come back, with the
    same component; rows of one id with different texts count as one document that is linked
    where any of its sets is. Extra columns are left out; an empty table gives no rows.
    """
    minima = bands_for(percent) * ROWS
    level = percent / 100 - SLACK * math.sqrt(percent / 100 * (1 - percent / 100) / min(LANES, minima)) / (1 - 2.0**-BITS)
    each = staged(features(df, id_col, text_col, words, percent))
    usable = each.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    same = [F.first(c).alias(c) for c in ["bands", *_SIGNATURE]]
    classes = staged(usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), *same))
    signed = classes.select("node", *_SIGNATURE)
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    shared = staged(rows.join(heads.select("bucket", "head", cells.alias("cells")), "bucket").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")))

    # rows of one id with different sets: their classes belong together
    twice = usable.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id")
    twice = usable.select("doc_id", "set_key").join(twice, "doc_id", "left_semi").distinct().join(classes.select("set_key", "node"), "set_key")
    given = twice.join(twice.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node")
    given = staged(given.select("a", F.col("node").alias("b")))

    needed = staged(shared.select("node").union(given.select("a")).union(given.select("b")).distinct())
    wanted = needed.select(F.col("node").alias(id_col))
    if needed.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).join(wanted, id_col, "left_semi")
    sets = staged(full_sets(texts, id_col, text_col, words))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links (a, b) among the pairs, on full sets."""
        left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("a_items"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("b_items"))
        common = F.size(F.array_intersect("a_items", "b_items")).cast("long")
        union = F.size("a_items").cast("long") + F.size("b_items") - common
        met = pairs.join(left, "a").join(right, "b")
        return met.where(100 * common >= percent * union).select(*pairs.columns)

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures do not rule a link out, with the estimate."""
        near = estimate(minima)
        met = pairs.join(renamed(signed, "a"), F.col("a") == F.col("a_node")).join(renamed(signed, "b"), F.col("b") == F.col("b_node"))
        return met.withColumn("near", near).where(F.col("near") >= level).select(*pairs.columns, "near")

    stars = shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    first = likely(stars).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    stars = staged(confirmed(first).union(given), given)
    found = components(stars)
    rooted = signed.join(needed, "node", "left_semi").join(found.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    every_cell = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")

    def open_rows() -> DataFrame:
        """bucket, cell, cells, node, root and signature of the buckets that hold several components."""
        rows = shared.select("bucket", "cell", "cells", "node").join(rooted, "node")
        ends = rows.groupBy("bucket", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("cells").alias("cells"))
        several = ends.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("cells").alias("cells")).where("lo < hi").select("bucket", every_cell)
        return staged(rows.join(several, ["bucket", "cell"]))

    def merged(links: DataFrame, *done: DataFrame) -> DataFrame:
        """``rooted`` after links (a, b) between roots; ``done`` are staged frames that only the links read."""
        links = staged(links.distinct(), *done)
        if links.isEmpty():
            discard(links)
            return rooted
        roots = components(links)
        renames = roots.select(F.col("node").alias("root"), F.col("root").alias("merged"))
        return staged(rooted.join(renames, "root", "left").withColumn("root", F.coalesce("merged", "root")).drop("merged"), rooted, roots, links)

    rooted = staged(rooted, found, stars)
    for turn in range(PIVOT_ROUNDS):
        rows = open_rows()
        drawn = F.struct(F.xxhash64("node", F.lit(turn)), "node", "root", *_SIGNATURE)
        in_cells = rows.groupBy("bucket", "cell").agg(F.min(drawn).alias("p"), F.first("cells").alias("cells"))
        pivots = in_cells.groupBy("bucket").agg(F.min("p").alias("p"), F.first("cells").alias("cells"))
        pivots = pivots.select("bucket", every_cell, *(F.col(f"p.{c}").alias(f"b_{c}") for c in ("node", "root", *_SIGNATURE)))
        near = rows.select("bucket", "cell", *(F.col(c).alias(f"a_{c}") for c in ("node", "root", *_SIGNATURE))).join(pivots, ["bucket", "cell"])
        near = near.withColumn("near", estimate(minima)).where((F.col("a_root") != F.col("b_root")) & (F.col("near") >= level))
        best = near.groupBy(F.col("a_node").alias("a")).agg(F.max(F.struct("near", "b_node", "a_root", "b_root")).alias("best"))
        links = confirmed(best.select("a", F.col("best.b_node").alias("b"), "best.a_root", "best.b_root"))
        rooted = merged(links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), rows)

    # each row goes to every pair of cells that holds its own; a bucket of one cell has one such pair
    open_now = open_rows()
    rows = open_now.join(sets.select(F.col("doc_id").alias("node"), "items"), "node").join(classes.select("node", "bands"), "node")
    pair = lambda k: F.struct(F.least("cell", k).alias("low"), F.greatest("cell", k).alias("high"))
    rows = rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("cells") - 1), pair)))
    rows = rows.select("bucket", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "cell", "node", "root", "bands", "items", *_SIGNATURE)
    left, right = renamed(rows, "a"), renamed(rows, "b")
    a_size, b_size = F.size("a_items").cast("long"), F.size("b_items").cast("long")
    common = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    met = (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_low") == F.col("b_low")) & (F.col("a_high") == F.col("b_high"))
    # two rows of one cell meet where both of the pair are that cell
    once = ((F.col("a_cell") != F.col("b_cell")) | (F.col("a_low") == F.col("a_high"))) & (F.col("a_root") < F.col("b_root"))
    may = (100 * F.least(a_size, b_size) >= percent * F.greatest(a_size, b_size)) & (estimate(minima) >= level)
    first_bucket = F.array_min(F.array_intersect("a_bands", "b_bands")) == F.col("a_bucket")
    linked = 100 * common >= percent * (a_size + b_size - common)
    rooted = merged(left.join(right, met & once & may & first_bucket & linked).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), open_now)
    discard(shared, needed, sets)

    named = classes.select("set_key", "node").join(rooted.groupBy("node").agg(F.min("root").alias("root")), "node", "left")
    named = named.select("set_key", F.coalesce("root", "node").alias("root"))
    out = each.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity of 0.85 or more."""
    return classes_with_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
