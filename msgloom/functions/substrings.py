"""Which texts hold one of many others, by hashes of blocks of 2^k bytes.

A text of m bytes, 2^k <= m < 2^(k + 1), is its first and its last 2^k bytes, which meet or
overlap. So it can stand at a place of another text only where the block of 2^k bytes hashes as
its first one does and the block that ends m bytes on as its last; a digest of the m bytes then
settles it. The hashes of all places for one k follow from those for k - 1, so texts are read
once for each k, whatever the number of texts that are looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are hashed at once (a longer text stands alone), and pairs of a place and a length.
BLOCK_BYTES = 1 << 18
PAIRS = 1 << 20
DIGESTS = "short string, size long, first long, last long, high long, low long"

_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _levels(data: bytes, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """k and the hashes of 2^k bytes from each place on, for k up to ``top``."""
    h = _BYTES[np.frombuffer(data, np.uint8)]
    for k in range(top + 1):
        yield k, h
        width = 1 << k
        if len(h) <= width:
            return
        h, after = h[:-width] * _ODD[0], h[width:]
        h += after
        h ^= h >> np.uint64(29)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about BLOCK_BYTES, each with the place of its first."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > BLOCK_BYTES:
            yield start, texts[start:k]
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, texts[start:]


def _digest(data: bytes) -> tuple[int, int]:
    d = blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _key(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    key = first * _ODD[1] + last
    key ^= key >> np.uint64(31)
    return key * _ODD[2] + size.astype(np.uint64)


def digests(texts: list[str], least: int) -> pa.RecordBatch:
    """Rows of DIGESTS: texts of fewer than ``least`` characters as they are, of the others size and hashes."""
    whole = [t for t in texts if len(t) < least]
    long = [t.encode() for t in texts if len(t) >= least]
    size = np.array([len(t) for t in long], np.int64)
    first, last = np.zeros(len(long), np.uint64), np.zeros(len(long), np.uint64)
    for at, block in _blocks(long):
        own = size[at : at + len(block)]
        ends = np.cumsum(own)
        level = np.array([n.bit_length() - 1 for n in own.tolist()])
        for k, h in _levels(b"".join(block), int(level.max())):
            here = np.flatnonzero(level == k)
            first[at + here] = h[ends[here] - own[here]]
            last[at + here] = h[ends[here] - (1 << k)]
    checks = np.array([_digest(t) for t in long], np.uint64).reshape(-1, 2)
    none = pa.nulls(len(whole), pa.int64())
    column = lambda x: pa.concat_arrays([pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64()), none])
    short = pa.concat_arrays([pa.nulls(len(long), pa.string()), pa.array(whole, pa.string())])
    return pa.RecordBatch.from_arrays([short, *map(column, (size, first, last, checks[:, 0], checks[:, 1]))], names=["short", "size", "first", "last", "high", "low"])


class Search:
    """Finds in many texts those that are a short one or hold one of the others, given rows of DIGESTS."""

    def __init__(self, rows: pa.Table) -> None:
        self.short = {t.encode() for t in rows.column("short").drop_null().to_pylist()}
        long = rows.filter(pc.is_valid(rows.column("size")))
        size, first, last, high, low = (long.column(c).to_numpy().view(np.uint64) for c in ("size", "first", "last", "high", "low"))
        level = np.frexp(size.astype(np.float64))[1] - 1
        self.levels = {}
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            key = _key(first[own], last[own], size[own])
            order = np.argsort(key)
            # each first block once, with the sizes that go with it
            pairs = np.unique(np.stack([first[own], size[own]], axis=1), axis=0)
            firsts, starts = np.unique(pairs[:, 0], return_index=True)
            bits = min(24, max(8, 4 + len(firsts).bit_length()))
            shift = np.uint64(64 - bits)
            marks = np.zeros(1 << bits, bool)
            marks[firsts >> shift] = True
            self.levels[k] = (marks, shift, firsts, np.append(starts, len(pairs)), pairs[:, 1].astype(np.int64), key[order], high[own][order], low[own][order])

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        found = np.array([t in self.short for t in texts], bool)
        if self.levels:
            for at, block in _blocks(texts):
                self.block(block, found[at : at + len(block)])
        return found

    def block(self, texts: list[bytes], found: np.ndarray) -> None:
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size)
        data = b"".join(texts)
        top = min(max(self.levels), max(0, int(size.max()).bit_length() - 1))
        for k, h in _levels(data, top):
            if k not in self.levels:
                continue
            marks, shift, firsts, starts, sizes, *entries = self.levels[k]
            places = np.flatnonzero(marks[(h >> shift).view(np.int64)])
            group = np.minimum(np.searchsorted(firsts, h[places]), len(firsts) - 1)
            met = firsts[group] == h[places]
            places, group = places[met], group[met]
            owner = np.searchsorted(ends, places, side="right")
            count = (starts[1:] - starts[:-1])[group]
            for cut in self.cuts(count):
                open_ = cut[~found[owner[cut]]]
                self.compare(data, h, 1 << k, places[open_], owner[open_], ends, starts[group[open_]], count[open_], sizes, entries, found)

    @staticmethod
    def cuts(count: np.ndarray) -> Iterator[np.ndarray]:
        """Places in runs that have about PAIRS sizes."""
        run = np.cumsum(count) // PAIRS
        yield from np.split(np.arange(len(count)), np.flatnonzero(np.diff(run)) + 1)

    @staticmethod
    def compare(data: bytes, h: np.ndarray, width: int, places: np.ndarray, owner: np.ndarray, ends: np.ndarray, start: np.ndarray, count: np.ndarray, sizes: np.ndarray, entries: list[np.ndarray], found: np.ndarray) -> None:
        """Each place with each size that goes with its block."""
        keys, high, low = entries
        each = np.repeat(np.arange(len(places)), count)
        size = sizes[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(each))]
        inside = places[each] + size <= ends[owner[each]]
        each, size = each[inside], size[inside]
        at = places[each]
        key = _key(h[at], h[at + size - width], size)
        near = np.searchsorted(keys, key)
        for k in np.flatnonzero(keys[np.minimum(near, len(keys) - 1)] == key).tolist():
            text, entry = owner[each[k]], int(near[k])
            if found[text]:
                continue
            mark = _digest(data[at[k] : at[k] + size[k]])
            while entry < len(keys) and keys[entry] == key[k]:
                found[text] |= mark == (int(high[entry]), int(low[entry]))
                entry += 1
