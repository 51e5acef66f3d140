"""Operator 11: phrase collocations by weighted acyclic automata.

1. Each task cuts its texts into pieces and words and gathers runs of RUN_WORDS words. A
   run's words, pairs of words and windows of three or four words are sorted and counted, and
   made into one automaton (``automata``) for each range of hashed prefixes; an entry's range
   follows from its language and its first three words, so no word or pair is in one range
   alone with all that follows it.
2. The automata of a range are united and their weights summed. Phrases of at least
   ``min_count`` occurrences are left, which all parts of such a phrase are too.
3. Candidates ask for the counts of their parts: each range of candidates asks for a part
   once, the questions go to the range of the part and are composed with its automaton, and
   the answers come back and are composed with the candidates' cuts.
4. Candidates that lie in a longer one with nearly as many occurrences go; the best of each
   language are ranked in two steps, and only these get their text.

Words travel as 64-bit hashes (two words of one language that collide would be one), those
that are common in a sample of SAMPLE_BYTES as places in a list that is broadcast, of at most
KNOWN words; the list only makes rows shorter, and no result depends on it. Counts are 64-bit, scores are worked out in unbounded integers.

Cases: null texts are empty; a null language is ``und`` and counts with texts of that
language; a row is a text whatever its id, so repeated rows count each; empty tables, and
texts without a phrase of two words that is frequent enough, give no rows; extra columns are
left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgloom.llm.automata import Automaton, summed, union
from msgloom.llm.common import slices, staged, table
from msgloom.llm.near_dup import mixed

UNKNOWN = "und"
#: Words of a phrase at most; words of a run; bytes of text, and phrases, of a range.
LONGEST = 4
RUN_WORDS = 1_000_000
RANGE_BYTES = 16 << 20
RANGE_PHRASES = 200_000
#: Groups of ranges that a run is dealt to at most.
FAN = 1024
#: Bytes of text that the list of common words is taken from, and its length.
SAMPLE_BYTES = 32 << 20
KNOWN = 1 << 20
#: Groups in which a language's phrases are ranked first.
SALTS = 64

#: A-Z to a-z, marks that end a piece to a full stop, tab to space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
_WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
FREQUENT = "bucket int, lang long, " + ", ".join(f"{w} long" for w in _WORDS) + ", size int, f long, word string"


def tokens(text: str) -> list[bytes]:
    """Words, with a full stop where a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).replace(b".", b" . ").split()


def range_of(hashes: np.ndarray, sequences: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each row of labels: hash of the language and the first three words."""
    h = np.zeros(len(sequences), np.uint64)
    for column in sequences.T[:LONGEST]:
        h += hashes[column]
        h = mixed(h)
    return (h % np.uint64(ranges)).astype(np.int32)


class Run:
    """Words of many texts, as numbers in order of appearance; 0 ends a piece."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.number[b"."] = 0
        self.langs: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.of: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None, lang: str | None) -> None:
        own = list(map(self.number.__getitem__, tokens(text or "")))
        if own:
            self.ids += [np.array(own, np.int32), np.zeros(1, np.int32)]
            self.of.append(np.full(len(own) + 1, self.langs.setdefault(UNKNOWN if lang is None else lang, len(self.langs)), np.int32))
            self.size += len(own)

    def rows(self, ranges: int, groups: int, known: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Range, packed automaton, and the words and languages of its sequences of one word."""
        if self.size:
            yield from dealt(*self.sequences(), ranges, groups, known)

    def sequences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
        """Hashes by label, distinct sequences of labels with their counts, and the texts of labels; the run is empty then."""
        spelled = [w for w, _ in sorted(self.number.items(), key=lambda x: x[1])][1:]
        names = list(self.langs)
        # labels in the order of the hashes of languages and words; 0 is none
        texts = [x.encode("utf-8", "surrogatepass") for x in names] + spelled
        found = np.array([xxhash.xxh3_64_intdigest(b"lang " + x) for x in texts[: len(names)]] + [xxhash.xxh3_64_intdigest(x) for x in spelled], np.uint64)
        hashes, inverse = np.unique(found, return_inverse=True)
        label = np.append(0, inverse + 1).astype(np.int32)
        text_of = dict(zip((inverse + 1).tolist(), texts, strict=True))
        hashes = np.append(np.uint64(0), hashes)
        ids = np.concatenate([*self.ids, np.zeros(LONGEST, np.int32)])
        n = len(ids) - LONGEST
        starts = np.flatnonzero(ids[:n])
        grid = np.zeros((len(starts), LONGEST + 1), np.int32)
        grid[:, 0] = label[np.concatenate(self.of)[starts] + 1]
        self.clear()
        going = np.ones(len(starts), bool)
        for k in range(LONGEST):
            own = ids[starts + k]
            going &= own > 0
            grid[:, k + 1] = np.where(going, label[np.where(own > 0, own + len(names), 0)], 0)
        del ids, starts, going, spelled
        parts = []
        for size in (1, 2, LONGEST):
            own = grid if size == 1 else grid[grid[:, min(size, 3)] > 0]
            s, w = summed(own[:, : size + 1], np.ones(len(own), np.int64))
            parts.append((np.pad(s, ((0, 0), (0, LONGEST - size))), w))
        del grid, own, s, w
        rows, weights = np.concatenate([s for s, _ in parts]), np.concatenate([w for _, w in parts])
        del parts
        order = in_order(rows, len(hashes))
        return hashes, rows[order], weights[order], text_of


def in_order(rows: np.ndarray, base: int) -> np.ndarray:
    """Order of distinct rows of labels below ``base`` that come as sorted words, pairs and longer windows behind each other."""
    if base > 1 << 20:
        return np.lexsort(rows.T[::-1])
    key = (rows[:, 0].astype(np.int64) * base + rows[:, 1]) * base + rows[:, 2]
    return np.argsort(key, kind="stable")  # merges the sorted parts; a pair stands before its windows


def dealt(hashes: np.ndarray, sequences: np.ndarray, weights: np.ndarray, text_of: dict[int, bytes], ranges: int, groups: int, known: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """One row for each of ``groups`` groups of neighbouring ranges that has sequences: distinct ones in order, of labels in the order of ``hashes``."""
    place = range_of(hashes, sequences, ranges).astype(np.int64) * groups // ranges
    order = np.argsort(place.astype(np.uint16) if groups <= 1 << 16 else place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(groups + 1))
    del place
    # kept for all groups, so that a group costs what it holds; numbers rise with labels, so rows stay in order
    used, number = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int32)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[k] : cuts[k + 1]]
        s = sequences[own]
        used[s] = True
        used[0] = False
        labels = np.flatnonzero(used)
        used[labels] = False
        number[labels] = np.arange(1, len(labels) + 1)
        s = number[s]
        single = s[(s[:, 1] > 0) & (s[:, 2] == 0)]
        text = b" ".join([text_of[x] for x in labels[single[:, 1] - 1].tolist()])
        which = b"\x00".join([text_of[x] for x in labels[single[:, 0] - 1].tolist()])
        yield k, Automaton.build(hashes[labels], s, weights[own]).pack(known), zstandard.compress(text, 1), zstandard.compress(which, 1)


def united(rows: pa.Table | pa.RecordBatch, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
    """Words, sequences, sums of weights, and the texts of words and languages by hash."""
    parts, texts = [], {}  # as ``union`` empties parts, a row is held once
    for k in range(rows.num_rows):
        own = Automaton.unpack(rows.column("automaton")[k].as_py(), known)
        s, w = own.sequences(LONGEST + 1)
        parts.append((own.words, s, w))
        single = s[(s[:, 1] > 0) & (s[:, 2] == 0)]  # in order, as they come from one level
        h = own.words[single - 1]
        texts.update(zip(h[:, 1].tolist(), zstandard.decompress(rows.column("spelled")[k].as_py()).split(b" "), strict=False))
        texts.update(zip(h[:, 0].tolist(), zstandard.decompress(rows.column("names")[k].as_py()).split(b"\x00"), strict=False))
        if sum(len(x) for _, x, _ in parts) > 4 * RUN_WORDS:
            parts = [union(parts)]
    return *union(parts), texts


def common_words(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of the words that repeat in a sample of the texts, ascending; at most KNOWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = Counter(w for text in part.column("text").to_pylist() for w in tokens(text or ""))
                hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

    sample = docs.select("text").sample(fraction=min(1.0, SAMPLE_BYTES / max(1, size)), seed=11)
    found = sample.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(KNOWN)
    return np.sort(found.select("w").toPandas()["w"].to_numpy(np.int64).view(np.uint64))


PACKED = "bucket int, automaton binary, spelled binary, names binary"


def packed(rows: Iterator[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "automaton", "spelled", "names"])


def fans(ranges: int) -> list[int]:
    """Groups of ranges after each exchange, each by about the same factor of at most FAN: the first are as many as the last of a group, so all of them keep many tasks busy."""
    levels = 1
    while FAN**levels < ranges:
        levels += 1
    return [-(-ranges // round(ranges ** ((levels - k) / levels))) for k in range(1, levels)] + [ranges]


def counted(docs: DataFrame, ranges: int, known) -> DataFrame:
    """Packed automata by range: bucket, automaton, and the texts of its words and languages.

    A run is dealt to FAN groups of ranges at most; where there are more ranges, the rows of a
    group are united in runs again and dealt on, so a run never makes many more than FAN rows.
    """
    steps = fans(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Run()

        for batch in batches:
            for part in slices(batch):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    own.add(text, lang)
                    if own.size >= RUN_WORDS:
                        yield packed(own.rows(ranges, steps[0], known.value))
        yield packed(own.rows(ranges, steps[0], known.value))
        # the worker goes on to other tasks
        pa.default_memory_pool().release_unused()

    rows = docs.mapInArrow(run, PACKED)
    for before, groups in zip(steps, steps[1:], strict=False):

        def deal_on(batches: Iterator[pa.RecordBatch], groups: int = groups) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                while at < batch.num_rows:  # as many automata at once as a run has bytes
                    n, size = 0, 0
                    while at + n < batch.num_rows and (not n or size < 8 * RUN_WORDS):
                        size += len(batch.column("automaton")[at + n].as_buffer())
                        n += 1
                    words, s, w, texts = united(batch.slice(at, n), known.value)
                    labels = {k + 1: texts[x] for k, x in enumerate(words.tolist()) if x in texts}
                    yield packed(dealt(np.append(np.uint64(0), words), s, w, labels, ranges, groups, known.value))
                    at += n

        rows = rows.repartition(before, "bucket").sortWithinPartitions("bucket").mapInArrow(deal_on, PACKED)
    return rows


def frequent(automata: DataFrame, known, min_count: int) -> DataFrame:
    """Phrases of one to LONGEST words with their counts, where frequent; and with size 0 each language's words in this range."""

    def unite(group: pa.Table) -> pa.Table:
        words, s, w, texts = united(group, known.value)
        sizes = (s[:, 1:] > 0).sum(axis=1)
        out, counts, lengths = [], [], []
        for size in (1, 2, LONGEST):
            keep = (sizes == size) & (w >= min_count)
            out.append(s[keep])
            counts.append(w[keep])
            lengths.append(np.full(int(keep.sum()), size))
        # threes are the sums of the windows that begin with them
        threes = s[sizes >= 3]
        threes[:, LONGEST:] = 0
        t, v = summed(threes, w[sizes >= 3])
        out.append(t[v >= min_count])
        counts.append(v[v >= min_count])
        lengths.append(np.full(len(out[-1]), 3))
        # all words of a language, frequent or not
        langs, totals = summed(s[sizes == 1][:, :1], w[sizes == 1])
        out.append(np.pad(langs, ((0, 0), (0, LONGEST))))
        counts.append(totals)
        lengths.append(np.zeros(len(langs), np.int64))
        label = np.append(np.uint64(0), words)
        rows = label[np.concatenate(out)]
        size = np.concatenate(lengths)
        text = [None] * len(rows)
        for k in np.flatnonzero(size <= 1).tolist():
            text[k] = texts[int(rows[k, size[k]])].decode("utf-8", "replace")
        bucket = pa.array(np.full(len(rows), group.column("bucket")[0].as_py() if group.num_rows else 0, np.int32))
        columns = [pa.array(c.view(np.int64)) for c in np.ascontiguousarray(rows.T)]
        return pa.table([bucket, *columns, pa.array(size.astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(text, pa.string())], names=["bucket", "lang", *_WORDS, "size", "f", "word"])

    return automata.groupBy("bucket").applyInArrow(unite, FREQUENT)


def empty(group: pa.Table) -> bool:
    """A side of a cogroup without rows comes without columns."""
    return not group.num_rows or "lang" not in group.column_names


def matrix(group: pa.Table) -> np.ndarray:
    return np.stack([group.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("lang", *_WORDS)], axis=1)


def automaton_of(rows: np.ndarray, weights: np.ndarray) -> Automaton:
    words = np.unique(rows)
    words = words[words > 0]
    return Automaton.build(words, *summed(np.where(rows > 0, np.searchsorted(words, rows) + 1, 0), weights))


def cut_scores(phrases: DataFrame, ranges: int) -> DataFrame:
    """lang, words, size, a, l, r, score of the candidates: their lowest-scoring cut, the smallest of equal ones."""
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(ranges)).cast("int")
    key = [F.col(c) for c in ("lang", *_WORDS)]
    # columns of their own, as a cogroup takes those of one origin on both sides for the same
    counts = phrases.where(f"size BETWEEN 1 AND {LONGEST - 1}").select(place(key).alias("at"), *(F.col(c).alias(c) for c in ("lang", *_WORDS, "f")))
    candidates = phrases.where("size >= 2").select(place(key).alias("origin"), "lang", *_WORDS, "size", "f")
    pad = lambda words: F.struct(*(w.alias(c) for w, c in zip([*words, *[F.lit(0).cast("long")] * (LONGEST - len(words))], _WORDS, strict=True)))
    w = [F.col(c) for c in _WORDS]
    parts = {size: F.array(*(pad(p) for k in range(1, size) for p in (w[:k], w[k:size]))) for size in range(2, LONGEST + 1)}
    part = F.when(F.col("size") == 2, parts[2]).when(F.col("size") == 3, parts[3]).otherwise(parts[4])
    asked = candidates.select("origin", "lang", F.explode(part).alias("p")).select("origin", "lang", "p.*").distinct()
    asked = asked.select(place(key).alias("at"), "origin", "lang", *_WORDS)

    names = ["origin", "lang", *_WORDS]

    def answer(questions: pa.Table, known: pa.Table) -> pa.Table:
        if empty(questions):  # parts that nobody asks for
            return pa.table([pa.array([], pa.int32()), *([pa.array([], pa.int64())] * (LONGEST + 2))], names=[*names, "f"])
        rows = matrix(questions)
        f = np.zeros(len(rows), np.int64) if empty(known) else automaton_of(matrix(known), known.column("f").to_numpy()).compose(rows)
        return questions.select(names).append_column("f", pa.array(f, pa.int64()))

    answers = asked.groupBy("at").cogroup(counts.groupBy("at")).applyInArrow(answer, "origin int, lang long, " + ", ".join(f"{c} long" for c in _WORDS) + ", f long")

    def cut(own: pa.Table, known: pa.Table) -> pa.Table:
        rows, a, sizes = matrix(own), own.column("f").to_numpy(), own.column("size").to_numpy()
        counts = automaton_of(matrix(known), known.column("f").to_numpy())
        left, right, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), 1 << 62)
        for k in range(1, LONGEST):
            one, two = rows.copy(), np.zeros_like(rows)
            one[:, k + 1 :] = 0
            two[:, 0] = rows[:, 0]
            two[:, 1 : LONGEST + 1 - k] = rows[:, k + 1 :]
            l, r = counts.compose(one), counts.compose(two)  # noqa: E741
            exact = [2_000_000 * int(x) // (int(y) + int(z)) if s > k else 1 << 62 for x, y, z, s in zip(a, l, r, sizes, strict=True)]
            score = np.array(exact, np.int64)
            better = score < best
            left, right, best = np.where(better, l, left), np.where(better, r, right), np.where(better, score, best)
        return own.drop_columns(["origin"]).append_column("l", pa.array(left)).append_column("r", pa.array(right)).append_column("score", pa.array(best))

    return candidates.groupBy("origin").cogroup(answers.groupBy("origin")).applyInArrow(cut, "lang long, " + ", ".join(f"{c} long" for c in _WORDS) + ", size int, f long, l long, r long, score long")


def without_contained(scored: DataFrame, contained: int) -> DataFrame:
    """Without the candidates that lie in a longer one with at least this percentage of their occurrences."""
    w = [F.col(c) for c in _WORDS]
    pad = lambda words: F.struct(*(x.alias(c) for x, c in zip([*words, *[F.lit(0).cast("long")] * (LONGEST - len(words))], _WORDS, strict=True)))
    inner = {size: F.array(*(pad(w[at : at + n]) for n in range(2, size) for at in range(size - n + 1))) for size in range(3, LONGEST + 1)}
    found = scored.where("size >= 3").select("lang", F.col("f").alias("longer"), F.explode(F.when(F.col("size") == 3, inner[3]).otherwise(inner[4])).alias("p"))
    most = found.select("lang", "p.*", "longer").groupBy("lang", *_WORDS).agg(F.max("longer").alias("longer"))
    kept = scored.join(most, ["lang", *_WORDS], "left")
    wide: Column = F.coalesce(F.col("longer"), F.lit(0)).cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * contained
    return kept.where(~wide | F.col("longer").isNull()).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, contained: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score. The module's text has the method and the cases."""
    docs = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = docs.sparkSession.sparkContext.broadcast(common_words(docs, size))
    automata = counted(docs, max(1, -(-size // RANGE_BYTES)), known)
    phrases = staged(frequent(automata, known, min_count))
    ranges = max(1, -(-phrases.count() // RANGE_PHRASES))
    totals = phrases.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"), F.max("word").alias("name"))
    words = phrases.where("size = 1").select("lang", F.col("w1").alias("w"), "word")
    scored = staged(cut_scores(phrases, ranges))
    order = [F.desc("score"), F.desc("f")]
    left = without_contained(scored, contained).withColumn("salt", F.pmod(F.xxhash64(*_WORDS), F.lit(SALTS)))
    first = left.withColumn("at", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    best = first.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= top).drop("at", "salt")
    spelled = best.select("*", F.posexplode(F.array(*_WORDS)).alias("place", "w")).where("w <> 0").join(words, ["lang", "w"])
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    whole = spelled.groupBy("lang", *_WORDS, "f", "l", "r", "score").agg(phrase.alias("phrase")).join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase"))
    ranked = whole.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.select(F.col("name").alias("lang"), "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, piece, row_number() OVER () AS p
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL)
), split AS (
  SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS MATERIALIZED (
  SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS pos FROM split
), four AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4
  FROM words WINDOW o AS (PARTITION BY p ORDER BY pos)
), grams AS (
  SELECT lang, [w1] AS g, 1 AS k, count(*) AS f FROM four GROUP BY lang, w1
  UNION ALL SELECT lang, [w1, w2], 2, count(*) FROM four WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], 3, count(*) FROM four WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], 4, count(*) FROM four WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, g, k, f AS a FROM grams WHERE k >= 2 AND f >= 30
), cuts AS (
  SELECT c.lang, c.g, c.k, c.a, x.f AS l, y.f AS r, i.i AS cut, (CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS score
  FROM cand c JOIN (SELECT unnest([1, 2, 3]) AS i) i ON i.i < c.k
  JOIN grams x ON x.lang = c.lang AND x.g = c.g[1 : i.i]
  JOIN grams y ON y.lang = c.lang AND y.g = c.g[i.i + 1 : c.k]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), held AS (
  SELECT lang, g[s : s + n - 1] AS g, max(a) AS longer
  FROM cand, (SELECT unnest([2, 3]) AS n), (SELECT unnest([1, 2, 3]) AS s)
  WHERE n < k AND s + n - 1 <= k GROUP BY 1, 2
), kept AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score
  FROM lowest LEFT JOIN held USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""
