"""Operator 10: benchmark decontamination by a BM25 index with block-max WAND.

The test items are indexed: for each word the items that have it and their BM25 impact, as
a share of the score that the item gets from its own words, so that one threshold serves
all items. Items stand in blocks, and the largest impact of a word in each block is kept.

Every passage of every text is a query: windows of twice the length that bounds an item's
class (64, 256, 1024, ... words), overlapping by half, so that each copy of an item lies whole
in one of them and an item's hits depend on no other item. Two bounds on what
a window can score, by the words' largest impacts and by those of each block, are computed
for all windows of a text at once; the windows that stay above the threshold run block-max
WAND, which finds every item above it. A found item counts if enough word shingles of its
question (all sentences but the last) and its answer (the last one) stand in the passage.

Statistics (the number of items, their mean length, in how many items each word is) are
those of all items, computed in Spark. Items are indexed by length class. A benchmark of
more than PART_BYTES of text is dealt to parts; one part's index at a time is broadcast, and
between parts the matches are staged and the broadcast is freed, so neither memory nor
scores depend on how many there are.

Items of fewer than SHINGLE words have too few words for a score and are matched as whole
phrases, word by word, instead; their score and overlaps are 1. An item of one or two
common words is thus found wherever these words are.

Cases: null and empty texts match nothing; null items and those without a word are left
out; repeated items are reported each; repeated documents are matched each; hits are in
order of item_id; empty tables give no matches; extra columns stay, one with the name of
the result is replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.common import append_columns, fresh, named, staged, table

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and shares of its shingles that must be there.
MIN_SCORE = 0.7
MIN_QUESTION = 0.8
MIN_ANSWER = 0.5
SHINGLE = 5
#: Items of a block, entries of the table of block maxima, and bytes of text of a part.
BLOCK = 8
TABLE = 8_000_000
PART_BYTES = 8 << 20

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(words: list[str]) -> set[tuple[str, ...]]:
    """Shingles of SHINGLE words, or the whole of fewer words."""
    size = min(SHINGLE, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()


def question_and_answer(text: str) -> tuple[set, set]:
    """Shingles of all sentences but the last, and of the last; of the whole for both if there is one only."""
    parts = [p for p in (words_of(s) for s in _SENTENCE.split(text)) if p]
    if len(parts) == 1:
        return grams(parts[0]), grams(parts[0])
    return grams([w for p in parts[:-1] for w in p]), grams(parts[-1])


@dataclass
class Statistics:
    """Of all items that are indexed: their number, mean length in words, and in how many each word is."""

    n: int
    mean: float
    found: dict[str, int]


def statistics(texts: list[str]) -> Statistics:
    """Statistics of items in memory, as ``match`` has them computed by Spark."""
    split = [w for w in map(words_of, texts) if len(w) >= SHINGLE]
    found: dict[str, int] = {}
    for words in split:
        for w in set(words):
            found[w] = found.get(w, 0) + 1
    return Statistics(len(split), sum(map(len, split)) / max(1, len(split)), found)


class Phrases:
    """Items of fewer than SHINGLE words, found as whole phrases."""

    def __init__(self) -> None:
        self.items: dict[tuple[str, ...], list[int | None]] = {}

    def add(self, words: list[str], item_id: int | None) -> None:
        self.items.setdefault(tuple(words), []).append(item_id)

    def hits(self, words: list[str]) -> list[int | None]:
        found: set[tuple[str, ...]] = set()
        for size in {len(p) for p in self.items}:
            found |= self.items.keys() & set(zip(*(words[k:] for k in range(size)), strict=False))
        return [item for phrase in found for item in self.items[phrase]]


@dataclass
class Index:
    """Items of one length class, which have ``longest`` words at most. Word number 0 stands for all words outside the index."""

    longest: int
    ids: list[int | None] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    items: list[list[int]] = field(default_factory=lambda: [[]])
    impacts: list[list[float]] = field(default_factory=lambda: [[]])
    checks: list[tuple[set, set]] = field(default_factory=list)

    def finish(self, texts: list[str], known: Statistics) -> Index:
        counts: list[dict[int, int]] = []
        sizes = []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            self.checks.append(question_and_answer(text))
            own: dict[int, int] = {}
            for w in words:
                t = self.words.setdefault(w, len(self.words) + 1)
                own[t] = own.get(t, 0) + 1
            counts.append(own)
        n, mean = len(texts), known.mean
        found = np.array([0, *(known.found[w] for w in self.words)])
        idf = np.log(1 + (known.n - found + 0.5) / (found + 0.5))
        self.items = [[] for _ in found]
        self.impacts = [[] for _ in found]
        for item, own in enumerate(counts):
            norm = K1 * (1 - B + B * sizes[item] / mean)
            each = {t: float(idf[t]) * f * (K1 + 1) / (f + norm) for t, f in own.items()}
            whole = sum(each.values())
            for t, impact in each.items():
                self.items[t].append(item)
                self.impacts[t].append(impact / whole)
        self.block = max(BLOCK, math.ceil(n * len(found) / TABLE))
        self.maxima = np.zeros((len(found), -(-n // self.block)), np.float32)
        for t, (items, impacts) in enumerate(zip(self.items, self.impacts, strict=True)):
            if items:
                np.maximum.at(self.maxima[t], np.array(items) // self.block, np.array(impacts, np.float32))
        self.highest = self.maxima.max(axis=1) if n else np.zeros(len(found), np.float32)
        return self

    def windows(self, terms: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Start and distinct index words of each window whose bounds reach the threshold."""
        step = self.longest
        starts = np.arange(0, max(1, len(terms) - step), step)
        padded = np.zeros(int(starts[-1]) + 2 * step, np.int32)
        padded[: len(terms)] = terms
        sums = np.append(0, np.cumsum(self.highest[padded], dtype=np.float64))
        starts = starts[sums[starts + 2 * step] - sums[starts] >= MIN_SCORE - 1e-3]
        kept = []
        for at in range(0, len(starts), 256):
            rows = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * step)[starts[at : at + 256]], axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = 0
            for k in np.flatnonzero(self.highest[rows].sum(axis=1) >= MIN_SCORE - 1e-3):
                own = rows[k][rows[k] > 0]
                if self.maxima[own].sum(axis=0).max() >= MIN_SCORE - 1e-3:
                    kept.append((int(starts[at + k]), own))
        return kept

    def search(self, terms: list[int]) -> dict[int, float]:
        """All items whose score reaches MIN_SCORE for a query of these words, by block-max WAND."""
        found: dict[int, float] = {}
        lists = [(self.items[t], self.impacts[t], self.maxima[t], float(self.highest[t])) for t in terms]
        # cursor: item now, list, place
        cursors = sorted([[items[0], k, 0] for k, (items, _, _, _) in enumerate(lists)])
        n = len(self.ids)
        while True:
            bound, pivot = 0.0, -1
            for at, (_, k, _) in enumerate(cursors):
                bound += lists[k][3]
                if bound >= MIN_SCORE - 1e-6:
                    pivot = at
                    break
            if pivot < 0 or cursors[pivot][0] >= n:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            ahead = cursors[: pivot + 1]
            if sum(float(lists[k][2][block]) for _, k, _ in ahead) >= MIN_SCORE - 1e-3:
                if cursors[0][0] == item:
                    score = sum(lists[k][1][place] for _, k, place in ahead)
                    if score >= MIN_SCORE:
                        found[item] = score
                    target = item + 1
                else:
                    target = item
            else:
                target = (block + 1) * self.block
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
            for cursor in ahead:
                items, place = lists[cursor[1]][0], cursor[2]
                while place < len(items) and items[place] < target:
                    place += 1
                cursor[0], cursor[2] = (items[place] if place < len(items) else n), place
            cursors.sort()

    def hits(self, words: list[str]) -> dict[int, tuple[float, float, float]]:
        """Items that the text holds: score and overlaps of question and answer."""
        number = self.words.get
        terms = np.array([number(w, 0) for w in words], np.int32)
        best: dict[int, tuple[float, float, float]] = {}
        for start, own in self.windows(terms):
            for item, score in self.search(own.tolist()).items():
                passage = words[start : start + 2 * self.longest]
                question, answer = self.checks[item]
                sizes = {len(next(iter(part))) for part in (question, answer)}
                there = {tuple(passage[k : k + size]) for size in sizes for k in range(len(passage) - size + 1)}
                got = (score, len(question & there) / len(question), len(answer & there) / len(answer))
                if got[1] >= MIN_QUESTION and got[2] >= MIN_ANSWER:
                    best[item] = max(best.get(item, got), got)
        return best


def build(rows: list[tuple[int | None, str | None]], known: Statistics | None = None) -> tuple[list[Index], Phrases]:
    """One index for each length class (at most 64, 256, 1024, ... words) that has items, and the phrases."""
    known = known or statistics([text or "" for _, text in rows])
    classes: dict[int, list[tuple[int | None, str]]] = {}
    phrases = Phrases()
    for item_id, text in rows:
        words = words_of(text)
        if len(words) >= SHINGLE:
            size = 64
            while size < len(words):
                size *= 4
            classes.setdefault(size, []).append((item_id, text or ""))
        elif words:
            phrases.add(words, item_id)
    made = []
    for size, group in sorted(classes.items()):
        # passages follow from the class and not from its items, so an item's hits don't depend on the others
        made.append(Index(size, [k for k, _ in group]).finish([text for _, text in group], known))
    return made, phrases


HIT = "item_id:long,score:double,question_overlap:double,answer_overlap:double"


def found_items(words: list[str], indexes: list[Index], phrases: Phrases) -> list[dict]:
    if not words:
        return []
    hits = [(index.ids[item], *got) for index in indexes for item, got in index.hits(words).items()]
    hits += [(item, 1.0, 1.0, 1.0) for item in phrases.hits(words)]
    hits.sort(key=lambda h: (h[0] is not None, h[0] or 0, h[1:]))
    return [dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), h, strict=True)) for h in hits]


def match(df: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", hits_col: str = "benchmark_hits") -> DataFrame:
    """``df`` with ``hits_col``: item_id, score, question_overlap, answer_overlap of the items each text holds."""
    rows = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    dealt = append_columns(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), ["text"], "words array<string>", lambda: lambda texts: [[words_of(t) for t in texts]])
    if parts > 1:
        dealt = staged(dealt)
    long = dealt.where(F.size("words") >= SHINGLE)
    n, mean = long.agg(F.count("*"), F.avg(F.size("words"))).first()
    each = long.select("part", F.explode(F.array_distinct("words")).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("found"))
    if parts > 1:
        counts = staged(counts)
    context = df.sparkSession.sparkContext
    columns = [fresh(df, f"hits_of_part_{part}") for part in range(parts)]
    before = None
    for part, column in enumerate(columns):
        own = dealt.where(F.col("part") == part).select("item_id", "text").orderBy("item_id", "text").collect()
        words = counts if parts == 1 else counts.join(each.where(F.col("part") == part).select("word").distinct(), "word", "left_semi")
        known = Statistics(n, mean or 0.0, {r.word: r.found for r in words.collect()})
        shared = context.broadcast(build([(r.item_id, r.text) for r in own], known))

        def make(shared=shared):
            return lambda texts: [[found_items(words_of(t), *shared.value) for t in texts]]

        df = append_columns(df, [text_col], f"`{column}` array<struct<{HIT}>>", make)
        if parts > 1:
            df = staged(df, *([before] if before is not None else []))
            before = df
            shared.destroy()
    hits = F.array_sort(F.concat(*named(columns))) if parts > 1 else F.col(f"`{columns[0]}`")
    # a column of the result's name that the caller has goes first
    return df.select(*named([c for c in df.columns if c not in columns and c.lower() != hits_col.lower()]), hits.alias(hits_col))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("benchmark_hits").alias("hit"))
    return found.select("doc_id", "hit.*")
