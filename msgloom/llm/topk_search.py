"""Operator 1: exact top-k by inner product, term at a time.

A term is a place in the vector; a posting is a row with a non-zero weight there. Rows are
packed, without a shuffle, into blocks that hold their postings: a list of (row, weight)
for a term that few rows of the block have, one weight a row for a term that most have.
Blocks of queries meet every block of candidates by an equi-join on a group of candidate
blocks. There, each sparse query row scatters its weighted postings into a dense array of
scores, a partition step selects the block's best, and a window merges the blocks' lists.

Both sides are blocks of bounded size, so neither is broadcast or gathered, and what the
exchanges carry is the candidates once and the queries once a group.

Cases: vectors that are null or hold null or non-finite components take no part, as do null
ids; rows may differ in length (a missing place is 0); ties go to the smaller id; a repeated
candidate row takes a rank for each copy; a query's own rows are all those of its id, so a
repeated query id is answered once, for its smallest vector, and by other ids only; fewer candidates than k give fewer rows; empty tables give none. Scores
are exact while they fit in 64 bits. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgloom.llm.common import table

#: Rows of a block of candidates and of queries, and the most candidates a group where groups need not be many.
CANDIDATES = 4096
QUERIES = 512
GROUP = 1 << 20


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Columns id and vector (array of long): floor(scale * x) of the usable vectors."""
    x: Column = F.col(vector_col)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))
    usable = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, bad)
    return df.where(usable).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("vector"),
    )


def _pack(ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> bytes:
    """Rows in ascending order of id as one buffer: counts, ids, then the dense matrix, narrow if it can be."""
    width = int(lengths.max(initial=0))
    dense = np.zeros((len(ids), width), np.int64)
    dense[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    order = np.argsort(ids, kind="stable")
    kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or np.abs(dense).max(initial=0) < 1 << (8 * int(k[2]) - 1))
    head = np.array([len(ids), width, int(kind[2])], "<i8")
    return head.tobytes() + ids[order].astype("<i8").tobytes() + dense[order].astype(kind).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, width, size = np.frombuffer(data, "<i8", 3)
    ids = np.frombuffer(data, "<i8", rows, 24)
    return ids, np.frombuffer(data, f"<i{size}", rows * width, 24 + 8 * rows).reshape(rows, width)


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """One row a block of up to ``rows`` rows: key (from its first id) and the packed block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            vector = whole.column("vector").combine_chunks()
            lengths = np.diff(vector.offsets.to_numpy())
            ids = whole.column("id").to_numpy().astype(np.int64)
            data = _pack(ids, lengths, vector.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([int(ids.min())], pa.int64()), pa.array([data], pa.binary())], names=["key", "block"])

        for batch in batches:
            while batch.num_rows:
                room = rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == rows:
                    yield block()
                    held = []
        if held:
            yield block()

    return vectors.mapInArrow(run, "key long, block binary")


def postings(matrix: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term the rows that have it and their weights; all rows where over half have it."""
    found = []
    for weights in np.ascontiguousarray(matrix.T):
        rows = np.flatnonzero(weights)
        found.append((slice(None), weights) if 2 * len(rows) > len(weights) else (rows, weights[rows]))
    return found


def select(scores: np.ndarray, allowed: np.ndarray | None, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to the smaller row."""
    rows = np.flatnonzero(allowed) if allowed is not None else None
    values = scores if rows is None else scores[rows]
    if len(values) > k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = np.flatnonzero(values > least)
        best = np.concatenate([above, np.flatnonzero(values == least)[: k - len(above)]])
    else:
        best = np.arange(len(values))
    return best if rows is None else rows[best]


def block_topk(candidates: bytes, queries: bytes, k: int) -> list[tuple[int, int, int]]:
    ids, matrix = _unpack(candidates)
    query_ids, wanted = _unpack(queries)
    most = int(np.abs(matrix).max(initial=0)) * int(np.abs(wanted).max(initial=0)) * max(1, wanted.shape[1])
    kind = np.int32 if most < 1 << 31 else np.int64
    lists = postings(matrix.astype(kind))
    scores, scratch = np.empty(len(ids), kind), np.empty(len(ids), kind)
    out = []
    for query_id, row in zip(query_ids, wanted.astype(kind), strict=True):
        scores[:] = 0
        for term in np.flatnonzero(row[: len(lists)]):
            rows, weights = lists[term]
            if isinstance(rows, slice):
                scores += np.multiply(weights, row[term], out=scratch)
            else:
                scores[rows] += weights * row[term]
        own = ids == query_id
        best = select(scores, ~own if own.any() else None, k)
        out += [(int(query_id), int(ids[b]), int(scores[b])) for b in best]
    return out


def topk(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """For each row (id, vector) of ``queries`` its k best rows of ``candidates``: query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    rows = candidates.count()
    groups = max(1, -(-rows // GROUP), min(-(-rows // CANDIDATES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = blocks(candidates, CANDIDATES).withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    asked = blocks(queries.groupBy("id").agg(F.min("vector").alias("vector")), QUERIES)
    right = asked.select(F.col("block").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = block_topk(batch.column("block")[row].as_py(), batch.column("asked")[row].as_py(), k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    # dealt by number, so that small blocks of many candidates aren't merged into few tasks
    meet = left.repartition(groups, "group").join(right.repartition(groups, "group"), "group").select("block", "asked")
    best = meet.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every row whose vec_id is divisible by 50."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256.0)
    return topk(vectors.where("id % 50 = 0"), vectors, 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id, score
FROM r WHERE rank <= 5
"""
