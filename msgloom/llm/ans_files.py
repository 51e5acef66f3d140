"""Operator 8: token ids as binary files, coded by a static range asymmetric numeral system.

Documents are dealt by ranges of doc_id to shards, each sorted, so that shard after shard
the ids stand in ascending order. A task turns the texts of its shard into ids and packs
them: up to SEGMENT ids share one frequency table, and within a segment each block of
about BLOCK ids (whole documents) is coded by itself, in LANES interleaved streams that
numpy handles side by side. A block carries its documents' ids and lengths, the lanes'
starting states, the same states again every CHECKPOINT steps with the place in the
payload, and a CRC-32, so blocks, and parts of blocks, decode in parallel and damage is seen.

A file set is a Parquet folder of rows (shard, segment, offset, n_symbols, table, blocks), one
for each segment. Reading takes the shards' sizes from the narrow columns and decodes every
segment where it is read, so no payload is shuffled. The running sum over the shards is one
small row for SHARD_DOCS documents, all in one task: some megabytes for a billion documents.

Cases: a null or empty text has the end id alone; a null doc_id sorts first; equal doc_ids
are ordered by their text; an empty table makes no rows; extra columns are left out.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgloom.llm.common import shared_folder, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
MAGIC = b"RANS"
#: Frequencies of a table add up to 2**SCALE; states are kept in [LOW, LOW << 32).
SCALE = 20
LOW = 1 << 31
LANES = 1024
BLOCK = 1 << 18
SEGMENT = 1 << 21
CHECKPOINT = 256
#: Documents a shard; shards up to which the list of their first places may be broadcast (16 bytes each), else it is joined by a shuffle.
SHARD_DOCS = 5000
BROADCAST_SHARDS = 500_000
#: Words a worker remembers the ids of.
MEMO_WORDS = 400_000

#: Precomposed Latin letters, without the one whose lower case is two characters, then marks without an apostrophe.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*)([.,;:!?|#$%&*()\"+=/\[\]-]*)")
#: The letters that byte-level tokenizers write for the 256 bytes: printable ones stand for themselves, others follow from U+0100.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in ascending order and their frequencies, each at least 1, with the sum 2**SCALE."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << SCALE
    freqs = np.maximum(1, counts * (total - len(symbols)) // counts.sum()).astype(np.int64)
    freqs[np.argmax(freqs)] += total - freqs.sum()
    return symbols.astype(np.uint32), freqs.astype(np.uint32)


def pack_table(symbols: np.ndarray, freqs: np.ndarray) -> bytes:
    return zlib.compress(struct.pack("<I", len(symbols)) + symbols.astype("<u4").tobytes() + freqs.astype("<u4").tobytes())


def unpack_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    (n,) = struct.unpack_from("<I", data)
    return np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, "<u4", n, 4 + 4 * n)


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray) -> None:
        self.symbols = symbols
        self.freqs = freqs.astype(np.uint64)
        self.starts = (np.cumsum(self.freqs) - self.freqs).astype(np.uint64)
        self.index = np.zeros(int(symbols[-1]) + 1, np.uint32)
        self.index[symbols] = np.arange(len(symbols), dtype=np.uint32)
        self._slots: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
        """The 32-bit words in the order of decoding, and (states, words before) at step 0 and each checkpoint."""
        lanes = max(1, min(LANES, len(ids) // 64))
        steps = -(-len(ids) // lanes)
        place = self.index[ids]
        states = np.full(lanes, LOW, np.uint64)
        groups: list[np.ndarray] = []
        marks: list[tuple[np.ndarray, int]] = []
        written = 0
        shift, scale = np.uint64(32), np.uint64(SCALE)
        limit = np.uint64((LOW >> SCALE) << 32)
        for step in range(steps - 1, -1, -1):
            part = place[step * lanes : (step + 1) * lanes]
            x = states[: len(part)]
            f = self.freqs[part]
            full = x >= f * limit
            words = x[full].astype(np.uint32)
            x[full] >>= shift
            q, r = np.divmod(x, f)
            x[:] = (q << scale) + r + self.starts[part]
            groups.append(words)
            written += len(words)
            if step % CHECKPOINT == 0:
                marks.append((states.copy(), written))
        groups.reverse()
        return np.concatenate(groups) if groups else np.zeros(0, np.uint32), [(s, written - w) for s, w in reversed(marks)]

    def decode(self, words: np.ndarray, states: np.ndarray, at: int, n: int) -> np.ndarray:
        """``n`` ids from the given states on, the next word being the one at ``at``."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freqs.astype(np.int64))
        lanes = len(states)
        states = states.copy()
        out = np.empty(n, np.uint32)
        mask, shift, scale = np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(SCALE)
        low = np.uint64(LOW)
        for start in range(0, n, lanes):
            x = states[: min(lanes, n - start)]
            slot = x & mask
            place = self._slots[slot]
            out[start : start + len(x)] = place
            x[:] = self.freqs[place] * (x >> scale) + slot - self.starts[place]
            short = np.flatnonzero(x < low)
            x[short] = (x[short] << shift) | words[at : at + len(short)]
            at += len(short)
        return self.symbols[out]


def pack_block(coder: Coder, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One self-contained block: directory, checkpoints, payload, and the CRC-32 of all before it."""
    words, marks = coder.encode(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = struct.pack("<4sIQIII", MAGIC, len(doc_ids), len(ids), len(marks[0][0]), len(marks), len(words))
    body = [head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes()]
    for states, before in marks:
        body += [struct.pack("<Q", before), states.astype("<u8").tobytes()]
    data = b"".join([*body, words.astype("<u4").tobytes()])
    return data + struct.pack("<I", zlib.crc32(data))


class Block:
    """A parsed block; ``ids()`` decodes all of it, ``part(k)`` what stands between two checkpoints."""

    def __init__(self, data: bytes, coder: Coder) -> None:
        if len(data) < 32 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block checksum does not match")
        magic, docs, self.n, lanes, marks, words = struct.unpack_from("<4sIQIII", data)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = struct.calcsize("<4sIQIII")
        known = np.frombuffer(data, np.uint8, docs, at)
        doc_ids = np.frombuffer(data, "<i8", docs, at + docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)]
        self.lengths = np.frombuffer(data, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        self.marks = []
        for _ in range(marks):
            (before,) = struct.unpack_from("<Q", data, at)
            self.marks.append((np.frombuffer(data, "<u8", lanes, at + 8), before))
            at += 8 + 8 * lanes
        self.words = np.frombuffer(data, "<u4", words, at).astype(np.uint64)
        self.coder = coder

    def part(self, k: int) -> np.ndarray:
        states, before = self.marks[k]
        start = k * CHECKPOINT * len(states)
        return self.coder.decode(self.words, states, before, min(self.n - start, CHECKPOINT * len(states)))

    def ids(self) -> np.ndarray:
        return np.concatenate([self.part(k) for k in range(len(self.marks))])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo(dict):
    """Remembers what ``make`` gives for each text."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        found = self[text] = self.make(text)
        return found


class WordIds:
    """Ids of whole texts by way of the ids of their words.

    The tokenizer drops white space and no rule of it looks across a space, so a text's ids
    are those of its space-separated parts in order. A part that is a Latin word with marks
    behind it is two pieces for the tokenizer's splitting rule, each of which its merge
    model takes directly; any other part goes through the whole tokenizer. Parts are
    remembered; a memory of over MEMO_WORDS of them starts afresh with the next slice.
    """

    def __init__(self, path: str) -> None:
        self.coder = tokenizer(path)
        self.model = self.coder.model
        self.memo = Memo(self.part)
        self.pieces = Memo(self.piece)

    def piece(self, text: str) -> bytes:
        shown = text.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(shown)] if text else []
        return struct.pack(f"<{len(ids)}H", *ids)

    def part(self, text: str) -> bytes:
        m = _SIMPLE.fullmatch(text)
        if m:
            return self.pieces[m[1].lower()] + self.pieces[m[2]]
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        for memo in (self.memo, self.pieces):
            if len(memo) > MEMO_WORDS:
                memo.clear()
        split = ((t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts)
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), "<u2") for words in split]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


FILE_SCHEMA = "shard int, segment int, offset long, n_symbols long, table binary, blocks array<binary>"


def _packer(path: str, end_id: int):
    def segment_row(shard: int, segment: int, offset: int, doc_ids: list, parts: list[np.ndarray]) -> dict:
        ids = np.concatenate(parts)
        symbols, freqs = frequency_table(ids)
        coder, start, first, held = Coder(symbols, freqs), 0, 0, 0
        packed = []
        for k, part in enumerate(parts):
            held += len(part)
            if held >= BLOCK or k == len(parts) - 1:
                packed.append(pack_block(coder, doc_ids[first : k + 1], [len(p) for p in parts[first : k + 1]], ids[start : start + held]))
                start, first, held = start + held, k + 1, 0
        return {"shard": shard, "segment": segment, "offset": offset, "n_symbols": len(ids), "table": pack_table(symbols, freqs), "blocks": packed}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from msgloom.llm.common import slices

        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("offset", pa.int64()), ("n_symbols", pa.int64()), ("table", pa.binary()), ("blocks", pa.list_(pa.binary()))])
        shard, segment, offset, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        coder = word_ids(path)
        end = np.array([end_id], "<u2")
        for batch in batches:
            for rows in slices(batch):
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), coder.ids(rows.column("text").to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    parts.append(np.concatenate([ids, end]))
                    held += len(parts[-1])
                    if held >= SEGMENT:
                        yield pa.RecordBatch.from_pylist([segment_row(shard, segment, offset, doc_ids, parts)], schema)
                        segment, offset, held, doc_ids, parts = segment + 1, offset + held, 0, [], []
        if parts:
            yield pa.RecordBatch.from_pylist([segment_row(shard, segment, offset, doc_ids, parts)], schema)

    return run


def write_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Writes the ids of every whole text, each document ended by ``end_id``, in ascending order of ``id_col``."""
    shards = max(1, -(-df.count() // SHARD_DOCS))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(_packer(vocabulary, end_id), FILE_SCHEMA).write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document from the files: doc_id, start (ids before it), ids (little-endian 32-bit)."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_symbols").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    if sizes.count() <= BROADCAST_SHARDS:
        before = F.broadcast(before)
    segments = files.join(before, "shard").select("table", "blocks", (F.col("shard_start") + F.col("offset")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                coder, at = Coder(*unpack_table(batch.column("table")[k].as_py())), batch.column("start")[k].as_py()
                for data in batch.column("blocks")[k].as_py():
                    block = Block(data, coder)
                    ids = block.ids().astype("<u4")
                    ends = np.cumsum(block.lengths)
                    starts = ends - block.lengths
                    for first in range(0, len(ends), 256):
                        last = min(first + 256, len(ends))
                        texts = [ids[s:e].tobytes() for s, e in zip(starts[first:last], ends[first:last], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids[first:last], pa.int64()), pa.array(at + starts[first:last], pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "start", "ids"])
                    at += len(ids)

    return segments.mapInArrow(run, "doc_id long, start long, ids binary")


def op8_ans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents to files in the shared folder and reports each from what is read back."""
    path = shared_folder(spark)
    write_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_files(spark, path).select(
        "doc_id",
        "start",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
