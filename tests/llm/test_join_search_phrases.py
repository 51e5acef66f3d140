"""Operators 11 to 13 against brute force, and their edge cases."""

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models_and_pairs import EDGES, brute_components, brute_sets, edge_docs

from msgloom.llm import automata, collocations, ngram_join, ranked_search
from msgloom.llm.common import table


def join_rows(df, **options):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes_with_components(df, **options).collect()}


def expected(rows, words, percent):
    sets = brute_sets(rows, words)
    want = brute_components(sets, percent)
    return {(k, len(sets[k]), want[k]) for k in sets}


def families():
    """A group of near copies about the threshold, one far below it, and texts around one shared passage."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(80)]
    base, passage = list(rng.choice(vocabulary, 150)), list(rng.choice(vocabulary, 60))
    rows = []
    for k in range(70):
        own = list(base)
        for at in rng.integers(0, 150, 1 + k % 6):
            own[at] = f"n{k}"
        rows.append((10_000 + k, " ".join(own)))
    for k in range(60):
        rows.append((20_000 + k, " ".join(passage + [f"p{k}q{j}" for j in range(8 + k % 30)])))
    for k in range(40):  # a chain: each text has moved on by two words
        rows.append((30_000 + k, " ".join(f"c{j}" for j in range(2 * k, 2 * k + 100))))
    return rows + [(40_001, "a b"), (40_002, "A  b"), (40_003, "a"), (40_004, " "), (40_005, None)]


@pytest.mark.parametrize("words, percent, small", [(4, 85, 32), (4, 85, 0), (2, 60, 0)])
def test_ngram_join_matches_brute_force(spark, sf_dir, monkeypatch, words, percent, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 16)  # tiles of several cells
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "ROUNDS", 3 if small else 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + families()
    assert join_rows(spark.createDataFrame(rows, docs.schema), words=words, percent=percent) == expected(rows, words, percent)


def test_ngram_join_tiles_only_of_rows_that_bounds_allow(spark):
    """Pairs whose first shared n-gram stands too late, or whose sizes differ too much, get no tile; all others do."""
    rng = np.random.default_rng(12)
    rows, want = [], set()
    for tile in range(3000):
        n = int(rng.integers(1, 6))
        sizes, guests = rng.integers(64, 128, n), rng.random(n) < 0.3
        places = [int(rng.integers(0, ngram_join.prefix_of(int(size), 85))) for size in sizes]
        fits = lambda j, k: min(sizes[j] - places[j], sizes[k] - places[k]) >= ngram_join.required(sizes[j], sizes[k], 85)  # noqa: E731, B023
        want |= {(tile, j) for j in range(n) for k in range(n) if j != k and not (guests[j] and guests[k]) and fits(j, k)}
        rows += [(tile, 0, j, int(sizes[j]), places[j], bool(guests[j])) for j in range(n)]
    rows += [(9000, 0, k, 100, 15, False) for k in range(ngram_join.FEW + 1)] + [(9001, 1, 0, 100, 15, True)]
    want |= {(9000, k) for k in range(ngram_join.FEW + 1)} | {(9001, 0)}
    given = spark.createDataFrame(rows, "tile long, salt short, node long, size long, pos int, guest boolean")
    prefix = F.col("size") - F.ceil(F.lit(85) * F.col("size") / 100) + 1
    told = ngram_join.packed(F.col("size"), F.col("pos"), prefix, F.col("guest")).alias("packed")
    for batch in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = ngram_join.shared_tiles(given.select("tile", "salt", "node", told), 85).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r.tile, r.node) for r in got} == want and len(got) == len(want)
        assert {(r.tile, r.node, r.size, r.guest) for r in got} <= {(t, j, size, guest) for t, _, j, size, _, guest in rows}
    assert len(want) < len(rows) / 2


def test_ngram_join_partner_bound():
    """The bound from a part of a prefix is never below that from the place itself, and is the same for short prefixes."""
    for percent in (60, 85, 100):
        for size in (1, 2, 7, 100, 900, 5000):
            prefix = ngram_join.prefix_of(size, percent)
            assert prefix == size - math.ceil(percent * size / 100) + 1
            places = np.arange(prefix)
            most = ngram_join.largest_partner(np.full(prefix, size), places * ngram_join.PARTS // prefix, percent)
            exact = np.array([max([0, *(m for m in range(2 * size + 1) if ngram_join.required(size, m, percent) <= size - p)]) for p in places[:: max(1, prefix // 50)]])
            assert (most[:: max(1, prefix // 50)] >= exact).all()
            if prefix <= ngram_join.PARTS:
                assert (most[:: max(1, prefix // 50)] == exact).all()


def test_ngram_join_edges(spark):
    got = ngram_join.classes_with_components(edge_docs(spark)).collect()
    assert len(got) == len(EDGES)
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k) for k, _ in EDGES}
    assert ngram_join.classes_with_components(edge_docs(spark).limit(0)).count() == 0
    # one id with two texts is one document
    twice = spark.createDataFrame([(5, "a b c d e"), (7, "a b c d e"), (7, "k l m n o p"), (9, "k l m n o p")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.classes_with_components(twice).collect()} == {5}


def test_ngram_join_bounds():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))
        y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        assert ngram_join.overlap_of(x, y) == common
        for width in (1, 8):
            differ = int(np.bitwise_count(ngram_join.bitmap(x, width) ^ ngram_join.bitmap(y, width)).sum())
            assert (len(x) + len(y) - differ) // 2 >= common
        for wide, narrow in ((8, 8), (32, 4), (1, 16)):
            assert ngram_join.bound_of(ngram_join.bitmap(x, wide), ngram_join.bitmap(y, narrow), len(x), len(y)) >= common
        linked = 100 * common >= 85 * (len(x) + len(y) - common)
        assert linked == (common >= ngram_join.required(len(x), len(y), 85))
    for percent in (40, 60, 85):
        for size in range(1, 5000):
            least = -(-size * percent // 100)
            assert ngram_join.bands_of(least, percent)[0] <= ngram_join.bands_of(size, percent)[0] <= ngram_join.bands_of(least, percent)[1]


# --- ranked search -----------------------------------------------------------
def brute_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(i, Counter(split(t))) for i, t in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n, length = len(texts), sum(s for _, _, s in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = set()
    for item, text in items:
        found = []
        for i, c, size in texts:
            m = 10 + (90 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out |= {(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("rows, pairs", [(4096, 48), (7, 6), (16, 0)])
def test_ranked_search_matches_brute_force(spark, sf_dir, monkeypatch, rows, pairs):
    monkeypatch.setattr(ranked_search, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ranked_search, "PAIR_TERMS", pairs)
    monkeypatch.setattr(ranked_search, "PART_BYTES", 4 << 20 if rows > 100 else 5000)  # several parts
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = {tuple(r) for r in ranked_search.topk(docs, items).select("item_id", "rank", "doc_id", "score").collect()}
    assert got == brute_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 10)


def test_ranked_search_edges(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(1, "plain WORDS"), (2, None), (3, "?!"), (4, "12345 word absent"), (None, "here xyz")], "item_id long, text string")
    got = {tuple(r) for r in ranked_search.topk(docs, items).collect()}
    assert got == brute_search(EDGES, [tuple(r) for r in items.collect()], 10)
    assert ranked_search.topk(docs.limit(0), items).count() == 0
    assert ranked_search.topk(docs, items.limit(0)).count() == 0


def test_ranked_search_bounds_hold_and_skip():
    rng = np.random.default_rng(4)
    skipped = 0
    for _ in range(60):
        n, terms = 200, 12
        dense = np.where(rng.random((terms, n)) < rng.random((terms, 1)), rng.integers(1, 1000, (terms, n)), 0)
        at = np.nonzero(dense.T)
        block = ranked_search.Block(at[0], at[1], dense.T[at], n)
        query = [int(t) for t in rng.permutation(terms)[:6]]
        whole = dense[query].sum(axis=0)
        least = int(np.sort(whole)[-5])
        groups = ranked_search.grouped(block, [t for t in query if t in block.lists])
        for bound, members in groups:
            assert bound >= dense[list(members)].sum(axis=0).max()
        rows, scores, completed = ranked_search.search(block, query, least)
        want = np.flatnonzero(whole >= max(1, least))
        assert rows.tolist() == want.tolist() and scores.tolist() == whole[want].tolist()
        skipped += n - completed
    assert skipped > 0


@pytest.mark.parametrize("marks", [26, 4])
def test_marked_rows_hold_all_asked(spark, monkeypatch, marks):
    """Every row asked for stays, negative ids too, and with room for the bits hardly another."""
    monkeypatch.setattr(ngram_join, "MARKS", marks)
    rows = spark.range(-20_000, 20_000).select(F.col("id").alias("node"), (F.col("id") * 7).alias("map"))
    asked = spark.range(-20_000, 20_000, 41).toDF("x")
    got = {r.node: r.map for r in ngram_join.marked(rows, "node", asked).collect()}
    assert set(got) >= set(range(-20_000, 20_000, 41)) and all(v == 7 * k for k, v in got.items())
    assert len(got) < (5_000 if marks == 26 else 40_001)
    assert ngram_join.marked(rows, "node", asked.limit(0)).count() == 0


# --- collocations ------------------------------------------------------------
def brute_phrases(rows, least, contained, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[s : s + n])) for n in range(1, 5) for s in range(len(words) - n + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        inside = any(o == lang and len(q) > len(p) and 100 * b >= contained * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for (o, q), b in found.items())
        if not inside:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranked, result = Counter(), set()
    for lang, score, a, phrase, left, right in sorted(out):
        ranked[lang] += 1
        if ranked[lang] <= top:
            result.add((lang, ranked[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return result


@pytest.mark.parametrize("run_words, range_bytes, range_phrases", [(2_000_000, 8 << 20, 200_000), (3000, 20_000, 50)])
def test_collocations_match_brute_force(spark, sf_dir, monkeypatch, run_words, range_bytes, range_phrases):
    for name, value in (("RUN_WORDS", run_words), ("RANGE_BYTES", range_bytes), ("RANGE_PHRASES", range_phrases), ("SALTS", 3), ("FAN", 256 if run_words > 5000 else 4)):
        monkeypatch.setattr(collocations, name, value)
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    rows = [tuple(r) for r in docs.collect()] + [(None, "x y z w x y z w, x y!"), ("und", "X Y\tz"), ("en", None), ("en", ""), ("en", "Ü ü é a b")]
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, docs.schema), min_count=6, top=40).collect()}
    assert got == brute_phrases(rows, 6, 80, 40)


def test_collocations_edges(spark):
    assert collocations.collocations(edge_docs(spark).limit(0)).count() == 0
    got = {tuple(r) for r in collocations.collocations(edge_docs(spark), min_count=2).collect()}
    assert got == brute_phrases([("en", t) for _, t in EDGES], 2, 80, 2000)


def test_collocations_exchanges_keep_tasks_busy():
    """However many ranges there are, the first exchange has some dozen groups, and no group is dealt to many more than FAN."""
    for ranges in (1, 64, 257, 375, 750, 1024, 1025, 4000, 60_000):
        steps = collocations.fans(ranges)
        assert steps[-1] == ranges and (ranges < 33 or steps[0] >= 32)
        assert all(b <= a * (collocations.FAN + 1) for a, b in zip([1, *steps], steps, strict=False))


def test_automaton_unites_and_composes():
    rng = np.random.default_rng(8)
    want = Counter()
    parts = []
    common = np.arange(0, 60, 3, dtype=np.uint64) * np.uint64(977)
    for _ in range(5):
        words = np.unique(rng.integers(1, 60, 25).astype(np.uint64)) * np.uint64(977)
        rows = rng.integers(1, len(words) + 1, (400, 4))
        rows[np.arange(4) >= rng.integers(1, 5, 400)[:, None]] = 0
        sequences, weights = automata.summed(rows, np.ones(400, np.int64))
        made = automata.Automaton.unpack(automata.Automaton.build(words, sequences, weights).pack(common), common)
        assert len(made.first) - 1 <= 1 + sum(len(np.unique(sequences[:, :d], axis=0)) for d in range(4))
        back, again = made.sequences(4)
        assert {(*r, w) for r, w in zip(back.tolist(), again.tolist(), strict=True)} == {(*r, w) for r, w in zip(sequences.tolist(), weights.tolist(), strict=True)}
        parts.append((made.words, back, again))
        label = np.append(np.uint64(0), words)
        for r, w in zip(label[sequences].tolist(), weights.tolist(), strict=True):
            want[tuple(r)] += w
    words, rows, weights = automata.union(parts)
    whole = automata.Automaton.build(words, rows, weights)
    asked = np.array([*want, (1, 0, 0, 0), (977, 5, 0, 0), (0, 0, 0, 0)], np.uint64)
    assert whole.compose(asked).tolist() == [*want.values(), 0, 0, 0]
    same_ends = automata.Automaton.build(np.arange(9, dtype=np.uint64), np.array([[1, 3, 4], [2, 3, 4], [5, 3, 4]]), np.ones(3, np.int64))
    assert len(same_ends.first) - 1 == 4  # one state each for the end, the last word, the two last, and the start


def test_automata_hold_rows_once():
    """The most that uniting and gathering hold, in bytes a row and a word."""
    rng = np.random.default_rng(9)
    rows, n = 40_000, 8
    tracemalloc.start()
    parts = [(np.arange(k, 50_000 + k, dtype=np.uint64), rng.integers(1, 50_000, (rows, 5)).astype(np.int32), np.ones(rows, np.int64)) for k in range(n)]
    tracemalloc.reset_peak()
    words, united, weights = automata.union(parts)
    assert weights.sum() == rows * n and tracemalloc.get_traced_memory()[1] < 105 * rows * n
    del parts, words, united, weights
    run = collocations.Run()
    for k in range(100):
        run.add(" ".join(f"w{x}" for x in rng.integers(0, 3000, 2000)), "en")
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    made = list(run.rows(21, 21, np.zeros(0, np.uint64)))
    assert {r[0] for r in made} == set(range(21)) and tracemalloc.get_traced_memory()[1] - held < 175 * 200_000
    tracemalloc.stop()
