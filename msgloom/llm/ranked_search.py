"""Operator 13: ranked lexical search by MaxScore with bounds of term pairs.

The texts are read twice. The first pass gives the statistics: the number of texts and of
words, and the texts that hold each term of the queries. In the second, each task builds an
inverted index of one block of texts after another and runs every query over it:

- A posting is a text and the term's impact there (weight times saturated frequency). For
  the block's PAIR_TERMS most frequent terms, the intersection list of each two of them is
  stored with its joint impacts and their maximum.
- A query's terms are taken in order of their largest impact. What a text can get from the
  first of them only is bounded by the sum of the maxima; where two of these terms have an
  intersection list, a bound for both is the larger of each alone and of the joint maximum,
  and disjoint pairs are chosen by what they save. As long as that bound lies below the
  query's current k-th score, no text that has only these terms can enter the result.
- The postings of the other terms are added up; of the texts met, those that could still
  reach the k-th score with the bound of the rest are completed, term by term or, for a
  pair, by one look into its list, from the largest bound to the smallest.

A task keeps k results a query over all its blocks, and hands out only these; two windows
merge them. Queries of more than PART_BYTES of text go in parts, each a pass of its own over
the texts, so what is broadcast stays bounded: PART_BYTES of text have so many terms.

Scores are 64-bit integers. Cases: null texts have no terms; texts without a term of the
query score nothing and are left out; null and empty queries give no rows; rows of one query
id are one query with the terms of all; repeated texts each take a rank; equal scores rank by
ascending id, null ids last; fewer matches than k give fewer rows; empty tables give none;
extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgloom.llm.common import slices, table

#: Bytes of query texts of a part, texts of a block, and its most frequent terms whose pairs have lists.
PART_BYTES = 4 << 20
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
PAIR_TERMS = 48
#: Groups in which a query's results are merged first.
SALTS = 64

_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split(b" ") if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """Inverted index of a block: postings by term number, largest impacts, and pair lists of frequent terms."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_rows: int) -> None:
        """Postings as three arrays of one length: row (ascending), term, impact."""
        order = np.argsort(terms, kind="stable")
        rows, terms, impacts = rows[order], terms[order], impacts[order]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(terms))
        self.n_rows = n_rows
        self.lists = {int(terms[s]): (rows[s:e], impacts[s:e]) for s, e in zip(starts, ends, strict=False)}
        self.highest = dict(zip(self.lists, np.maximum.reduceat(impacts, starts).tolist() if len(starts) else [], strict=True))
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        frequent = sorted(self.lists, key=lambda t: (-len(self.lists[t][0]), t))[:PAIR_TERMS]
        dense = np.zeros((len(frequent), n_rows), np.int64)
        for k, t in enumerate(frequent):
            dense[k, self.lists[t][0]] = self.lists[t][1]
        self.dense = dict(zip(frequent, dense, strict=True))
        there = dense > 0
        for b, t in enumerate(frequent):
            for a, s in enumerate(frequent[:b]):
                rows_of_both = np.flatnonzero(there[a] & there[b])
                joint = dense[a][rows_of_both] + dense[b][rows_of_both]
                self.pairs[min(s, t), max(s, t)] = (rows_of_both, joint, int(joint.max(initial=0)))

    def pair(self, s: int, t: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Intersection list, joint impacts and their maximum, if both are frequent terms."""
        return self.pairs.get((min(s, t), max(s, t)))

    def pair_bound(self, s: int, t: int) -> int:
        """Most that a text can get from both terms."""
        alone = self.highest[s] + self.highest[t]
        found = self.pair(s, t)
        return alone if found is None else max(self.highest[s], self.highest[t], found[2])


def grouped(block: Block, terms: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """Disjoint pairs and single terms with their bounds, pairs that save most first; in ascending order of bound."""
    frequent = [t for t in terms if t in block.dense]
    gains = []
    for a, s in enumerate(frequent):
        for t in frequent[:a]:
            bound = block.pair_bound(s, t)
            gains.append((block.highest[s] + block.highest[t] - bound, bound, s, t))
    gains.sort(reverse=True)
    used: set[int] = set()
    out: list[tuple[int, tuple[int, ...]]] = []
    for gain, bound, s, t in gains:
        if gain > 0 and s not in used and t not in used:
            used |= {s, t}
            out.append((bound, (s, t)))
    out += [(block.highest[t], (t,)) for t in terms if t not in used]
    return sorted(out)


def search(block: Block, terms: list[int], least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of the block that score at least ``least`` (and above 0), their scores, and how many texts were completed."""
    none = np.zeros(0, np.int64)
    terms = [t for t in terms if t in block.lists]
    if not terms:
        return none, none, 0
    groups = grouped(block, terms)
    bounds = np.cumsum([bound for bound, _ in groups])
    rest = int(np.searchsorted(bounds, least))  # groups whose bounds add up to less than least
    if rest == len(groups):
        return none, none, 0
    scores = np.zeros(block.n_rows, np.int64)
    for _, members in groups[rest:]:
        for t in members:
            rows, impacts = block.lists[t]
            scores[rows] += impacts
    found = np.flatnonzero(scores)
    values = scores[found]
    if rest:
        keep = values + bounds[rest - 1] >= least
        found, values = found[keep], values[keep]
    completed = len(found)
    for k in range(rest - 1, -1, -1):
        values = values + gathered(block, groups[k][1], found)
        if k:
            keep = values + bounds[k - 1] >= least
            found, values = found[keep], values[keep]
    keep = values >= max(1, least)
    return found[keep], values[keep], completed


def gathered(block: Block, members: tuple[int, ...], rows: np.ndarray) -> np.ndarray:
    """What the rows get from one term or from a pair: its list has the joint impact, the others have one of the terms."""
    if all(t in block.dense for t in members):
        if len(members) == 2:
            shared, joint, _ = block.pair(*members)
            out = np.maximum(block.dense[members[0]][rows], block.dense[members[1]][rows])
            at = np.minimum(np.searchsorted(shared, rows), max(0, len(shared) - 1))
            both = shared[at] == rows if len(shared) else np.zeros(len(rows), bool)
            out[both] = joint[at[both]]
            return out
        return block.dense[members[0]][rows]
    out = np.zeros(len(rows), np.int64)
    for t in members:
        own, impacts = block.lists[t]
        at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
        out += np.where(own[at] == rows, impacts[at], 0)
    return out


class Best:
    """The k best results of a query so far: (score, id) with ties to the smaller id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.rows: list[tuple[int, bool, int]] = []

    def add(self, ids: list[int | None], scores: np.ndarray) -> None:
        self.rows = sorted(self.rows + [(-s, i is None, i or 0) for i, s in zip(ids, scores.tolist(), strict=True)])[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def statistics(docs: DataFrame, vocabulary) -> tuple[int, int, dict[int, int]]:
    """Texts with a term, all terms of all texts, and the texts that hold each term number of the broadcast vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        found = np.zeros(len(number), np.int64)
        texts = words = 0
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    all_terms = terms_of(text)
                    n = len(all_terms) - all_terms.count(b"")
                    texts += n > 0
                    words += n
                    found[[number[t] for t in number.keys() & set(all_terms)]] += 1
        terms = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-2, -1])), pa.array(np.append(found[terms], [words, texts]))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r.term: r.n for r in rows}
    return counts.pop(-1, 0), counts.pop(-2, 0), counts


def part_topk(docs: DataFrame, queries: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    """query, score, doc_id: the best of each task for each query number."""
    context = docs.sparkSession.sparkContext
    vocabulary = {t: number for number, t in enumerate(sorted({t for _, terms in queries for t in terms}))}
    shared = context.broadcast(vocabulary)
    n, length, found = statistics(docs, shared)
    weights = np.array([weight(n, found.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    asked = context.broadcast((weights, [[vocabulary[t] for t in terms] for _, terms in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, (weights, terms_by_query) = shared.value, asked.value
        best = [Best(k) for _ in terms_by_query]
        held: list[tuple[int | None, list[tuple[int, int]], int]] = []

        def answer() -> None:
            lengths = np.array([len(own) for _, own, _ in held], np.int64)
            flat = np.array([x for _, own, _ in held for pair in own for x in pair], np.int64).reshape(-1, 2)
            norms = np.array([10 + (90 * size * n) // length for _, _, size in held], np.int64)
            impacts = weights[flat[:, 0]] * ((1_000_000_000 * flat[:, 1]) // (1000 * flat[:, 1] + 8 * np.repeat(norms, lengths)))
            block = Block(np.repeat(np.arange(len(held)), lengths), flat[:, 0], impacts, len(held))
            for own, terms in zip(best, terms_by_query, strict=True):
                rows, scores, _ = search(block, terms, own.least)
                if len(rows) > 4 * k:  # only rows that reach the block's own k-th score
                    high = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    rows, scores = rows[high], scores[high]
                if len(rows):
                    own.add([held[r][0] for r in rows.tolist()], scores)
            held.clear()

        size = 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    all_terms = terms_of(text)
                    counts = Counter(map(number.get, all_terms))
                    counts.pop(None, None)
                    if counts:
                        held.append((doc_id, list(counts.items()), len(all_terms) - all_terms.count(b"")))
                        size += len(text)
                    if len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                        answer()
                        size = 0
        if held:
            answer()
        out = [(q, -s, None if null else i) for q, own in enumerate(best) for s, null, i in own.rows]
        columns = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "score", "doc_id"])

    return docs.mapInArrow(run, "query long, score long, doc_id long")


def topk(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """For each query its k highest-scoring texts: item_id, rank, doc_id, score. The module's text has the score and the cases."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_id_col).cast("long").alias("item_id"), F.col(query_text_col).alias("text")).where("text IS NOT NULL")
    asked = asked.groupBy("item_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    found = spark.createDataFrame([], "item_id long, score long, doc_id long")
    for part in range(parts):
        own = asked.where(F.col("part") == part).select("item_id", "text").collect()
        rows = [(r.item_id, sorted(set(terms_of(r.text)) - {b""})) for r in own]
        if rows:
            names = F.broadcast(spark.createDataFrame([(q, item) for q, (item, _) in enumerate(rows)], "query long, item_id long"))
            found = found.union(part_topk(docs, rows, k).join(names, "query").select("item_id", "score", "doc_id"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item, over all whole documents."""
    return topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH dt AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), stats AS (
  SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS all_terms FROM dt WHERE len(t) > 0
), words AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM dt) GROUP BY r, term
), item_terms AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM words, stats WHERE term IN (SELECT term FROM item_terms) GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // all_terms)))) AS BIGINT) AS score
  FROM item_terms JOIN words USING (term) JOIN weights USING (term), stats
  GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
