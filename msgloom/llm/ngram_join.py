"""Operator 12: exact Jaccard join on word n-grams by size-banded tiles with bitmaps.

1. Each whole text becomes its set of word n-grams, as 64-bit hashes; documents with equal
   sets are one class, named by its smallest id. From here on only classes are compared.
2. A linked pair shares an n-gram among the first ones of both sets in any fixed order
   (prefix filter), and its sizes lie in one size band or in near ones. A tile is an n-gram
   and a band: a class is a member of the tiles of its own band for each n-gram of its
   prefix, and a guest in those of the larger bands that its partners may have. Every linked pair thus meets in
   a tile. The order puts n-grams that a count of repeats inside slices of text found to be
   common last, so passages that many documents share make no tiles; the counts only choose
   the order, so results never depend on them. The places of the first n-gram that two sets
   share bound their overlap, so a row tells its place, and of a tile with few rows those
   stay that are within the bounds of another. That leaves most n-grams shared by chance
   without a tile. Tiles with the same classes count once.
3. ROUNDS times, each class of a tile meets one class drawn from it. Sizes and the bit counts
   of hashed bitmaps bound the overlap from above; the best of what they leave is confirmed
   by intersecting the sorted sets. Tiles that hold one component are done; that settles
   groups of near copies by one comparison a class.
4. In tiles that still hold several components every two classes of different ones are
   compared: in small tiles pair by pair in a join, in others cell by cell, with bit counts of bitmaps as wide as the sets ask for against a whole cell at once, then sorted-array intersection of the few left. Links join components at once, so
   the pairs of a group are never made into rows.

A tile's rows are dealt to cells of about CELL_BYTES of sets, and comparisons by pairs of
cells, so no task gets a whole tile however hot its n-gram is. Step 4 is quadratic, in bit
counts only, in families of texts that share rare n-grams and stay below the threshold.

Cases: null and wordless texts have an empty set and are linked with nothing; a text of
fewer words than the n-gram is one n-gram; a row without an id takes no part and has a null
component; repeated rows all come back; rows of one id with different texts are one
document, linked where any of its sets is; an empty table gives no rows; extra columns are
left out.
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
from msgloom.llm.near_dup import components, full_sets, shingles

#: Words of 64 bits of the bitmap that travels with a class.
BITMAP = 8
#: Rounds in which the classes of a tile meet a drawn one.
ROUNDS = 2
#: Bytes of sets in a cell, most rows of one, and parts that rows of a hot tile are dealt to before its size is known.
CELL_BYTES = 8 << 20
CELL_ROWS = 4096
SALTS = 16
#: Rows of a tile that are held against each other by size and place when tiles are made; larger tiles stay whole.
FEW = 32
#: Parts of a prefix by which a row tells its n-gram's place there.
PARTS = 127
#: Rows of a tile whose pairs are still compared one by one in step 4.
SMALL = 32
#: Ids up to which the list of texts to read again may be broadcast (16 bytes each); else it is joined by a shuffle.
BROADCAST_IDS = 500_000
#: log2 of the bits of a list of marks at most, which is broadcast (8 MB); ids beyond a sixteenth of them share bits.
MARKS = 26
#: N-grams held by a task before it counts repeats, repeats that it reports, and n-grams in the list of common ones.
COUNTED = 4_000_000
REPEATS = 2
COMMON = 500_000
#: log2 of the repeats from which a common n-gram's tiles are dealt to SALTS parts.
HOT = 10

_BITS = [f"s{k}" for k in range(BITMAP)]


def required(size_a: int | np.ndarray, size_b: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap of two sets of these sizes that are linked: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def bands_of(size: int, percent: int) -> tuple[int, int]:
    """Band of a set of this size, and of the largest set that it may be linked with; each band doubles the size."""
    return size.bit_length() - 1, (100 * size // percent).bit_length() - 1


def width_for(size: int) -> int:
    """Words of a bitmap with about four bits for each item, a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, size / 16))))


def bitmap(items: np.ndarray, words: int) -> np.ndarray:
    """Parity of the number of items that hash to each of 64 * words bits."""
    counts = np.bincount((items % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<u8")


def common_grams(df: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to COMMON n-grams that repeat within the texts of a task, ascending, and the log2 of the repeats of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def repeats() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= REPEATS
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["gram", "n"])

        total = 0
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    held.append(shingles(text, words))
                    total += len(held[-1])
                    if total >= COUNTED:
                        yield repeats()
                        total = 0
        if held:
            yield repeats()

    found = df.select(F.col(text_col).alias("text")).mapInArrow(run, "gram long, n long")
    # a bounded list: what it lacks is ordered as rare
    listed = found.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(COMMON).select("gram", F.floor(F.log2("n")).cast("byte").alias("rank"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("gram", "rank")], names=["gram", "rank"])

    rows = listed.mapInArrow(pack, "gram binary, rank binary").collect()
    grams, ranks = (np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind) for c, kind in (("gram", np.uint64), ("rank", np.int8)))
    order = np.argsort(grams)
    return grams[order], ranks[order]


def features(df: DataFrame, id_col: str, text_col: str, words: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_shingles, set_key (null for the empty set), bands, prefix (common n-grams last, and their number) and bitmap of each row."""
    schema = "doc_id long, n_shingles long, set_key binary, band int, last int, prefix array<long>, hot int, map binary, " + ", ".join(f"{s} long" for s in _BITS)
    shared = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ranks = shared.value
        for batch in batches:
            for part in slices(batch):
                counts, keys, bands, prefixes, hot, maps, bits = [], [], [], [], [], [], []
                for text in part.column("text").to_pylist():
                    items = shingles(text, words)
                    n = len(items)
                    counts.append(n)
                    keys.append(xxhash.xxh3_128_digest(items.tobytes()) if n else None)
                    bands.append(bands_of(n, percent) if n else (None, None))
                    first = prefix_of(n, percent) if n else 0
                    if len(grams) and n:
                        at = np.minimum(np.searchsorted(grams, items), len(grams) - 1)
                        rank = np.where(grams[at] == items, ranks[at], 0)
                        order = np.argsort(rank, kind="stable")[:first]
                        hot.append(int((rank[order] >= HOT).sum()))
                        prefixes.append(items[order].view(np.int64))
                    else:
                        hot.append(0)
                        prefixes.append(items[:first].view(np.int64))
                    maps.append(bitmap(items, width_for(n)).tobytes())
                    bits.append(bitmap(items, BITMAP).view(np.int64))
                arrays = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x, pa.int32()) for x in zip(*bands, strict=True)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(hot, pa.int32()), pa.array(maps, pa.binary())]
                arrays += [pa.array(column, pa.int64()) for column in np.array(bits).T]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "band", "last", "prefix", "hot", "map", *_BITS])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def overlap_bound(percent: int) -> Column:
    """Upper bound of the overlap of a and b (columns a_size, a_s0, .. and b_size, ..), null if it rules a link out."""
    differ = F.lit(0)
    for s in _BITS:
        differ = differ + F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}")))
    overlap = F.least(F.col("a_size"), F.col("b_size"), F.floor((F.col("a_size") + F.col("b_size") - differ) / 2))
    return F.when(100 * overlap >= percent * (F.col("a_size") + F.col("b_size") - overlap), overlap)


def prefix_of(size: int | np.ndarray, percent: int) -> int | np.ndarray:
    """N-grams of a set of this size of which a linked set has one at least."""
    return size + (-percent * size // 100) + 1


def largest_partner(size: np.ndarray, part: np.ndarray, percent: int) -> np.ndarray:
    """Size of the largest set that may be linked with one of this size, if the first n-gram of both is in this part of its prefix.

    What comes before that place is not shared, so the overlap is at most size - place.
    """
    place = -(-part * prefix_of(size, percent) // PARTS)
    return (100 + percent) * (size - place) // percent - size


def packed(size: Column, place: Column, prefix: Column, guest: Column) -> Column:
    """What a row of a tile tells of its class, in one long: the part of the prefix (7 bits), the size (31 bits) and guest."""
    part = F.floor(place.cast("long") * PARTS / prefix).cast("long")
    return F.shiftleft(part, 56).bitwiseOR(F.shiftleft(size.cast("long"), 1)).bitwiseOR(guest.cast("long"))


def within_bounds(tile: np.ndarray, size: np.ndarray, most: np.ndarray, guest: np.ndarray, going: int | None) -> np.ndarray:
    """Which rows, in order of their tiles, may be linked with another of their tile.

    Two rows may be if neither is larger than the other's ``most`` and one is no guest. Rows
    of tiles with more than FEW rows, and of the tile ``going`` of which others came before, all may.
    """
    starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    counts = np.diff(np.append(starts, len(tile)))
    keep = np.repeat(counts > FEW, counts)
    for n in np.unique(counts[(counts > 1) & (counts <= FEW)]):
        at = starts[counts == n][:, None] + np.arange(n)
        fits = size[at][:, None, :] <= most[at][:, :, None]
        met = fits & fits.transpose(0, 2, 1) & ~(guest[at][:, None, :] & guest[at][:, :, None]) & ~np.eye(n, dtype=bool)
        keep[at] = met.any(axis=2)
    if going is not None and tile[0] == going:
        keep[: counts[0]] = True
    return keep


def shared_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """tile, node, size, guest of the rows (tile, salt, node, packed) that may be linked with another of their tile.

    Rows of dealt tiles, with a salt above 0, all stay. Rows come in order of their tiles as
    a stream, of which a task holds a batch and up to FEW rows.
    """

    def kept(batch: pa.RecordBatch, going: int | None) -> pa.RecordBatch:
        told = batch.column("packed").to_numpy()
        size, guest = (told >> 1) & 0x7FFFFFFF, (told & 1).astype(bool)
        most = largest_partner(size, told >> 56, percent)
        keep = within_bounds(batch.column("tile").to_numpy(), size, most, guest, going) | (batch.column("salt").to_numpy() > 0)
        arrays = [batch.column("tile"), batch.column("node"), pa.array(size.astype(np.int32)), pa.array(guest)]
        return pa.RecordBatch.from_arrays(arrays, names=["tile", "node", "size", "guest"]).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going = None, None  # rows of a tile that may go on in the next batch; a tile of which rows have left
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            tile = batch.column("tile").to_numpy()
            last = len(tile) - int(np.argmax(np.append(tile[::-1] != tile[-1], True)))
            if tile[-1] != going and len(tile) - last <= FEW:
                held, batch = batch.slice(last), batch.slice(0, last)
            if batch.num_rows:
                yield kept(batch, going)
            going = None if held is not None else tile[-1]
        if held is not None:
            yield kept(held, None)

    # in this order the bytes that differ between rows of a class lie together, which compresses best
    ordered = rows.select("salt", "node", "packed", "tile").repartition("tile", "salt").sortWithinPartitions("tile", "salt")
    return ordered.mapInArrow(run, "tile long, node long, size int, guest boolean")


def bound_of(x: np.ndarray, y: np.ndarray, size_x: int, size_y: int) -> int:
    """Upper bound of the overlap by two bitmaps, the wider one folded to the other's width."""
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return min(size_x, size_y, (size_x + size_y - int(np.bitwise_count(x ^ y).sum())) // 2)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of the ids, without a shuffle of the texts while the list of ids is bounded."""
    ids = staged(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def marked(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be in ``ids`` (one column), so that fewer rows go into a shuffled join, which decides.

    A bit for the hash of each id is broadcast, so the list is bounded whatever their number.
    """
    bits = 1 << min(MARKS, max(15, (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)).cast("long")
    # buckets from 1, positions from 0 in each, as the bitmap functions count
    own = ids.select(place(F.col(ids.columns[0])).alias("h"))
    marks = own.groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    found = rows.withColumn("_h", place(F.col(column))).withColumns({"_bucket": F.bitmap_bucket_number("_h"), "_at": F.bitmap_bit_position("_h")})
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(_at div 8 + 1 AS int)"), F.lit(1))), 16, 10).cast("int")
    met = found.join(F.broadcast(marks), "_bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 AS int))")) != 0)
    return met.select(*rows.columns)


def confirmed(pairs: DataFrame, maps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) that are linked.

    Bit counts of bitmaps as wide as the sets (``maps``: node, size, map) rule most others
    out; for the rest the sorted sets of the texts (``docs``: doc_id, text) are intersected.
    """
    names, schema = pairs.columns, pairs.schema
    given = staged(pairs)
    maps = marked(maps, "node", given.select(F.explode(F.array("a", "b"))))
    sides = given.join(maps.select(F.col("node").alias("a"), F.col("size").alias("a_n"), F.col("map").alias("a_map")), "a")
    sides = sides.join(maps.select(F.col("node").alias("b"), F.col("size").alias("b_n"), F.col("map").alias("b_map")), "b")

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_map", "b_map")), strict=True):
                kept.append(bound_of(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), n, m) >= required(n, m, percent))
            yield batch.select(names).filter(pa.array(kept, pa.bool_()))

    pairs = staged(sides.select(*names, "a_n", "b_n", "a_map", "b_map").mapInArrow(may, schema).distinct(), given)
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    met = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    met = met.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in batches:
            for part in slices(batch):
                linked = []
                for b, one, two in zip(part.column("b").to_pylist(), part.column("a_text").to_pylist(), part.column("b_text").to_pylist(), strict=True):
                    if (b, two) != last:
                        last, y = (b, two), shingles(two, words)
                    x = shingles(one, words)
                    linked.append(bool(len(x)) and overlap_of(x, y) >= required(len(x), len(y), percent))
                yield part.select(names).filter(pa.array(linked, pa.bool_()))

    return met.select(*names, "a_text", "b_text").mapInArrow(run, schema)


def overlap_of(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two arrays of distinct items in one order."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    x, y = x.view(np.uint64), y.view(np.uint64)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


class Roots:
    """Union of the roots that the links of a task join."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (up := self.above.get(top, top)) != top:
            top = up
        while (up := self.above.get(x, x)) != top:
            self.above[x] = top
            x = up
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.above[max(x, y)] = min(x, y)


def cell_links(roots: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, within: bool, percent: int, known: Roots) -> list[tuple[int, int]]:
    """Links between different roots in one pair of cells; ``sides`` says which of the two cells a row is of.

    All rows of a side are held against one row at a time: sizes, then bit counts. What
    these leave is intersected, unless links found meanwhile have joined the roots.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    width = width_for(int(sizes.max()))
    maps = np.stack([bitmap(s.view(np.uint64), width) for s in sets])
    found = []
    left = np.flatnonzero(sides == 0)
    for x in left:
        others = left[left > x] if within else np.flatnonzero(sides == 1)
        others = others[roots[others] != roots[x]]
        if not len(others):
            continue
        need = required(sizes[x], sizes[others], percent)
        fits = np.minimum(sizes[others], sizes[x]) >= need
        others, need = others[fits], need[fits]
        differ = np.bitwise_count(maps[others] ^ maps[x]).sum(axis=1, dtype=np.int64)
        for y in others[(sizes[x] + sizes[others] - differ) // 2 >= need]:
            a, b = int(roots[x]), int(roots[y])
            if known.find(a) != known.find(b) and overlap_of(sets[x], sets[y]) >= required(int(sizes[x]), int(sizes[y]), percent):
                known.join(a, b)
                found.append((min(a, b), max(a, b)))
    return found


def classes_with_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Documents are linked if 100 * intersection >= percent * union of their sets of word
    n-grams; component_id is the smallest doc_id reachable over links. The module's text has
    the cases.
    """
    each = staged(features(df, id_col, text_col, words, percent, common_grams(df, text_col, words)))
    usable = each.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    same = [F.first(c).alias(c) for c in ["n_shingles", "band", "last", "prefix", "hot", "map", *_BITS]]
    classes = staged(usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), *same).withColumnRenamed("n_shingles", "size"))
    # prefixes and bitmaps are read from the classes only
    each = staged(each.select("doc_id", "n_shingles", "set_key"), each)
    usable = each.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    signed = classes.select("node", "size", *_BITS)

    # members and guests of tiles; tiles with one class or with guests only hold no pair
    rows = classes.select("node", "size", "prefix", "hot", "band", F.explode(F.sequence("band", "last")).alias("at"))
    salt = F.when(F.col("pos") >= F.size("prefix") - F.col("hot"), 1 + F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0).cast("short")
    guest = F.col("at") > F.col("band")
    # a guest's partners are of the tile's band, so a smaller part of its prefix is enough
    enough = F.expr(f"{100 + percent} * (size - pos) >= {percent} * (size + shiftleft(1L, at))")
    rows = rows.select("*", F.posexplode("prefix").alias("pos", "gram")).where(~guest | enough)
    rows = rows.select(F.xxhash64("gram", "at").alias("tile"), salt.alias("salt"), "node", packed(F.col("size"), F.col("pos"), F.size("prefix"), guest).alias("packed"))
    rows = staged(shared_tiles(rows, percent))
    # hashes over the rows tell whether two tiles hold the same classes in the same roles
    marks = [F.bit_xor(F.xxhash64("node", "guest", F.lit(k))).alias(f"mark_{k}") for k in range(2)]
    heads = rows.groupBy("tile").agg(F.count("*").alias("n"), F.bool_and("guest").alias("idle"), F.sum("size").alias("total"), *marks).where("n > 1 AND NOT idle")
    heads = heads.groupBy("n", "mark_0", "mark_1", "total").agg(F.min("tile").alias("tile"))
    parts = F.greatest(F.ceil(F.col("total") * 8 / CELL_BYTES), F.ceil(F.col("n") / CELL_ROWS)).cast("int")
    shared = rows.join(heads.select("tile", parts.alias("cells")), "tile").withColumn("cell", F.pmod(F.xxhash64("node", F.lit(9)), F.col("cells")).cast("int"))
    shared = staged(shared.select("tile", "cell", "cells", "node"), rows)

    # rows of one id with different sets: their classes belong together
    twice = usable.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id")
    twice = usable.select("doc_id", "set_key").join(twice, "doc_id", "left_semi").distinct().join(classes.select("set_key", "node"), "set_key")
    given = twice.join(twice.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node").select("a", F.col("node").alias("b"))

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    maps = classes.select("node", "size", "map")
    # marks may let others through, which are in no tile and so keep their own root
    needed = staged(shared.select("node").distinct())
    rooted = staged(marked(signed, "node", needed).withColumn("root", F.col("node")), needed)
    every_cell = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")

    def merged(links: DataFrame, *done: DataFrame) -> DataFrame:
        """``rooted`` after links (a, b) between roots; ``done`` are staged frames that only the links read."""
        links = staged(links.distinct(), *done)
        if links.isEmpty():
            discard(links)
            return rooted
        roots = components(links)
        renames = roots.select(F.col("node").alias("root"), F.col("root").alias("merged"))
        return staged(rooted.join(renames, "root", "left").withColumn("root", F.coalesce("merged", "root")).drop("merged"), rooted, roots, links)

    def open_rows() -> DataFrame:
        """Rows of the tiles that hold several components, with root, size and bitmap."""
        found = shared.join(rooted, "node")
        ends = found.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("cells").alias("cells")).where("lo < hi")
        return staged(found.join(ends.select("tile", every_cell), ["tile", "cell"]))

    names = ("node", "root", "size", *_BITS)
    for turn in range(ROUNDS):
        rows = open_rows()
        drawn = F.struct(F.xxhash64("node", F.lit(turn)), "node", "root", "size", *_BITS)
        in_cells = rows.groupBy("tile", "cell").agg(F.min(drawn).alias("p"), F.first("cells").alias("cells"))
        pivots = in_cells.groupBy("tile").agg(F.min("p").alias("p"), F.first("cells").alias("cells"))
        pivots = pivots.select("tile", every_cell, *(F.col(f"p.{c}").alias(f"b_{c}") for c in names))
        near = rows.select("tile", "cell", *(F.col(c).alias(f"a_{c}") for c in names)).join(pivots, ["tile", "cell"])
        near = near.where("a_root <> b_root").withColumn("bound", overlap_bound(percent)).where("bound IS NOT NULL")
        share = F.col("bound") / (F.col("a_size") + F.col("b_size"))
        best = near.groupBy(F.col("a_node").alias("a")).agg(F.max(F.struct(share.alias("share"), "b_node", "a_root", "b_root")).alias("best"))
        links = confirmed(best.select("a", F.col("best.b_node").alias("b"), "best.a_root", "best.b_root"), maps, docs, words, percent)
        rooted = merged(links.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")), rows)

    # small tiles: the pairs that bounds allow, each once
    rows = open_rows()
    counts = rows.groupBy("tile").agg(F.count("*").alias("n"))
    few = rows.join(counts.where(F.col("n") <= SMALL).select("tile"), "tile", "left_semi")
    side = lambda s: few.select("tile", *(F.col(c).alias(f"{s}_{c}") for c in names))
    met = side("a").join(side("b"), "tile").where((F.col("a_root") < F.col("b_root")) & overlap_bound(percent).isNotNull())
    links = confirmed(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_root", "b_root").distinct(), maps, docs, words, percent)
    links = links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))

    # others: each row goes to every pair of cells that holds its own; a tile of one cell has one such pair
    pair = lambda k: F.struct(F.least("cell", k).alias("low"), F.greatest("cell", k).alias("high"))
    many = rows.join(counts.where(F.col("n") > SMALL).select("tile"), "tile", "left_semi")
    dealt = many.select("tile", "cell", "node", "root", F.explode(F.transform(F.sequence(F.lit(0), F.col("cells") - 1), pair)).alias("pair"))
    sets = full_sets(texts_of(docs, many.select(F.col("node").alias("doc_id"))), "doc_id", "text", words)
    dealt = dealt.join(sets.select(F.col("doc_id").alias("node"), "items"), "node").select("tile", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "cell", "root", "items")

    def run(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        items = group.column("items").combine_chunks()
        sets_here = [s.values.to_numpy() for s in items]
        sides = np.where(group.column("cell").to_numpy() == low, 0, 1)
        found = cell_links(group.column("root").to_numpy(), sets_here, sides, low == high, percent, Roots())
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rooted = merged(links.union(dealt.groupBy("tile", "low", "high").applyInArrow(run, "a long, b long")), rows)
    # ids with several sets: links between classes that may have no tile
    ids = given.join(rooted.select(F.col("node").alias("a"), F.col("root").alias("a_root")), "a", "left").join(rooted.select(F.col("node").alias("b"), F.col("root").alias("b_root")), "b", "left")
    ids = staged(ids.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct())
    own = classes.select("set_key", "node").join(rooted.groupBy("node").agg(F.min("root").alias("root")), "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    if not ids.isEmpty():
        last = components(ids).select(F.col("node").alias("root"), F.col("root").alias("merged"))
        own = own.join(last, "root", "left").select("set_key", F.coalesce("merged", "root").alias("root"))
    discard(shared)
    out = each.select("doc_id", "n_shingles", "set_key").join(own, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under four-word n-grams and a similarity of 0.85 or more."""
    return classes_with_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
