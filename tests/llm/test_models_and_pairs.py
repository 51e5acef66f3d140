"""Operators 3, 5, 6, 7, 9, 10 against brute force or held-out accuracy, and their edge cases."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgloom.llm import decontaminate, language_id, license_scan, near_dup, pii, quality
from msgloom.llm.common import table

LONG = "word " * 40_000
EDGES = [(1, ""), (2, None), (3, "plain words here"), (3, "plain words here"), (4, LONG), (5, "x" * 100_000), (6, "12345 !!! \n\n"), (None, "no id at all")]


def edge_docs(spark):
    return spark.createDataFrame([(k, t, "en", 1.5) for k, t in EDGES], "doc_id long, text string, lang string, score double")


# --- near duplicates ---------------------------------------------------------
def brute_sets(docs, words):
    sets = {}
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc_id] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    return sets


def brute_components(sets, percent):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_dup_matches_brute_force(spark, sf_dir, words, percent):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(60)]
    base = list(rng.choice(vocabulary, 80))
    family = []
    for k in range(60):  # a group of copies with about as many changes as the threshold allows
        own = list(base)
        for at in rng.integers(0, 80, 1 + k % 5):
            own[at] = f"n{k}"
        family.append((10_000 + k, " ".join(own)))
    docs = docs.union(spark.createDataFrame(family + [(20_001, "a b"), (20_002, "A  b"), (20_003, "a"), (20_004, " "), (20_005, None)], docs.schema))
    sets = brute_sets([tuple(r) for r in docs.collect()], words)
    want = brute_components(sets, percent)
    for r in near_dup.classes_with_components(docs, words=words, percent=percent).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_dup_edges(spark):
    got = near_dup.classes_with_components(edge_docs(spark)).collect()
    assert len(got) == len(EDGES)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(k, k, True) for k, _ in EDGES}
    assert near_dup.classes_with_components(edge_docs(spark).limit(0)).count() == 0
    gone = spark.createDataFrame([(3,)], "doc_id long")
    assert near_dup.without_ids(edge_docs(spark), gone, "doc_id").count() == len(EDGES) - 2


def test_near_dup_of_one_id_with_two_texts(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(5, " ".join(words)), (5, " ".join(reversed(words))), (3, " ".join(words)), (9, " ".join([*reversed(words), "end"])), (8, "other words entirely here")]
    got = sorted((r.doc_id, r.component_id) for r in near_dup.classes_with_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (8, 8), (9, 3)]


def test_near_dup_with_many_cells(spark, monkeypatch):
    """A bucket dealt to many cells: copies around a common core that are linked in chains only, or not at all."""
    monkeypatch.setattr(near_dup, "CELL", 4)
    rng = np.random.default_rng(8)
    core = [f"c{k}" for k in range(90)]
    rows = []
    for k in range(70):
        own = list(core)
        for at in rng.integers(0, 90, 1 + k % 4):
            own[at] = f"x{k}"
        rows.append((k, " ".join(own)))
    sets = brute_sets(rows, 3)
    want = brute_components(sets, 85)
    assert 5 < len(set(want.values())) < 65
    got = near_dup.classes_with_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_signature_estimate_is_close():
    rng = np.random.default_rng(2)
    minima = near_dup.Minima(85)
    for share in (0.5, 0.85):
        misses = []
        for _ in range(20):
            both, n = rng.integers(0, 1 << 62, 400, np.uint64), int(400 * (1 - share) / (2 * share))
            a, b = (np.concatenate([both, rng.integers(0, 1 << 62, n, np.uint64)]) for _ in range(2))
            x, y = minima.of(a)[1], minima.of(b)[1]
            lanes = [(int(p) >> s & 15) == (int(q) >> s & 15) for p, q in zip(x, y, strict=True) for s in range(0, 64, 4)][:120]
            misses.append((sum(lanes) / 120 - 1 / 16) / (15 / 16) - share)
        assert abs(np.mean(misses)) < 0.04


# --- decontamination ---------------------------------------------------------
def test_search_finds_all_items_above_the_threshold():
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"v{k}" for k in range(300)])
    texts = [" ".join(rng.choice(vocabulary, rng.integers(6, 40))) for _ in range(90)]
    (index,), _ = decontaminate.build(list(enumerate(texts)))
    for item in range(0, 90, 7):
        query = set(texts[item].split()) | set(rng.choice(vocabulary, 60))
        terms = sorted(index.words[w] for w in query if w in index.words)
        scores = np.zeros(90)
        for t in terms:
            scores[index.items[t]] += index.impacts[t]
        got = index.search(terms)
        assert set(got) == set(np.flatnonzero(scores >= decontaminate.MIN_SCORE)) and item in got


def test_decontaminate_finds_planted_items_and_leaves_the_rest(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").collect()
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    planted = [(50_000 + i.item_id, f"{docs[i.item_id][1]}\n{i.text} {docs[i.item_id + 1][1]}") for i in items]
    cut = [(60_000 + i.item_id, " ".join(i.text.split()[: len(i.text.split()) // 2])) for i in items]
    df = spark.createDataFrame(docs + planted + cut, "doc_id long, text string")
    found = {(r.doc_id, h.item_id) for r in decontaminate.match(df, table(spark, sf_dir, "benchmark")).collect() for h in r.benchmark_hits}
    exact = {(d, i.item_id) for d, t in docs + planted for i in items if i.text in t}
    assert exact <= found and not any(d >= 60_000 for d, _ in found)
    words = {d: " ".join(decontaminate.words_of(t)) for d, t in docs + planted}
    assert all(" ".join(decontaminate.words_of(next(i.text for i in items if i.item_id == k))) in words[d] for d, k in found)


def test_decontaminate_edges(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 40)
    items = spark.createDataFrame([(1, "one two three four five. six seven eight"), (1, "one two three four five. six seven eight"), (2, "too short"), (3, None), (None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    docs = edge_docs(spark).union(spark.createDataFrame([(9, LONG + "One two three four five. Six seven eight " + LONG, "en", 0.0), (10, "alpha beta gamma delta epsilon zeta", "en", 0.0)], edge_docs(spark).schema))
    got = {r.doc_id: [h.item_id for h in r.benchmark_hits] for r in decontaminate.match(docs, items).collect()}
    assert got[9] == [1, 1] and got[10] == [None] and all(got[k] == [] for k, _ in EDGES)
    short = spark.createDataFrame([(11, "It was (too, short) for that"), (12, "too shortly"), (13, "Too\nshort")], "doc_id long, text string")
    hits = {r.doc_id: [tuple(h) for h in r.benchmark_hits] for r in decontaminate.match(short, items).collect()}
    assert hits == {11: [(2, 1.0, 1.0, 1.0)], 12: [], 13: [(2, 1.0, 1.0, 1.0)]}
    assert decontaminate.match(docs, items.limit(0)).where("size(benchmark_hits) > 0").count() == 0


def test_decontaminate_scores_do_not_depend_on_the_parts(spark, sf_dir, monkeypatch):
    items = table(spark, sf_dir, "benchmark")
    held = items.limit(40).select((F.col("item_id") + 70_000).alias("doc_id"), F.concat(F.lit("Before it. "), "text", F.lit(" and after")).alias("text"))
    # torn: other words between the question and the answer
    gap = " ".join(f"gap{k}" for k in range(45))
    last = F.regexp_extract("text", r"(?s)^(.*[.?!])\s+(\S.*)$", 2)
    torn = items.where(F.length(last) > 0).select((F.col("item_id") + 80_000).alias("doc_id"), F.concat(F.regexp_extract("text", r"(?s)^(.*[.?!])\s+(\S.*)$", 1), F.lit(f" {gap} "), last).alias("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(held).union(torn)
    found = []
    for size in (1 << 30, 20_000, 700):
        monkeypatch.setattr(decontaminate, "PART_BYTES", size)
        found.append(sorted((r.doc_id, *h) for r in decontaminate.match(docs, items).collect() for h in r.benchmark_hits))
    assert len(found[0]) >= 40 and found[0] == found[1] == found[2]
    assert sum(h[0] >= 80_000 for h in found[0]) > 5


def test_decontaminate_hits_of_an_item_alone_and_beside_longer_ones():
    question = "which of the seven old lighthouses on the northern coast still burns whale oil today?"
    answer = "The one at Skarra harbour burns it."
    item = f"{question} {answer}"
    said = decontaminate.words_of(f"{question} " + " ".join(f"gap{k}" for k in range(50)) + f" {answer}")
    longer = " ".join(f"long{k}" for k in range(60))
    known = decontaminate.statistics([item, longer])
    alone = decontaminate.found_items(said, *decontaminate.build([(1, item)], known))
    beside = decontaminate.found_items(said, *decontaminate.build([(1, item), (2, longer)], known))
    assert alone == beside and [h["item_id"] for h in alone] == [1]


# --- language ----------------------------------------------------------------
def test_forward_pass_sums_all_segmentations():
    pieces = language_id.shared_pieces()
    p = np.random.default_rng(1).random((pieces.n + 1, 2)) / 1000
    p[-1] = 0
    word = "theory"
    arcs = pieces.arcs([word])[0]

    def total(start):
        if start == 1 + len(word):
            return np.ones(2)
        out = language_id.FLOOR * total(start + 1)
        for l in range(1, arcs.shape[1] + 1):
            if start + l <= 1 + len(word) and arcs[start, l - 1] >= 0:
                out = out + p[arcs[start, l - 1]] * total(start + l)
        return out

    assert np.allclose(language_id.forward(arcs[None], p)[0, -1], total(0))


def brute_log_score(word, p, pieces):
    """Log of the sum over all segmentations, one column a language, by exact sums of logarithms."""
    known = {int(h): k for k, h in enumerate(pieces.hashes)}
    text = "\u2581" + word
    at = [np.zeros(p.shape[1])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        terms = [at[end - 1] + np.log(language_id.FLOOR)]
        for l in range(1, min(end, pieces.longest) + 1):
            piece = known.get(language_id.Pieces._hash(text[end - l : end]))
            if piece is not None:
                terms.append(at[end - l] + np.log(p[piece]))
        at[end] = np.logaddexp.reduce(terms)
    return at[-1]


def test_long_words_score_as_brute_force(monkeypatch):
    pieces = language_id.shared_pieces()
    assert pieces.longest > 12 and np.array_equal(pieces.find(pieces.hashes), np.arange(pieces.n))
    p = np.random.default_rng(2).random((pieces.n + 1, 2)) / 5000
    p[-1] = 0
    model = language_id.Model(["a", "b"], p)
    words = ["theory", "internationalisation", "x" * 31, "theoryofcomputation" * 11, "q" * 900, "das" * 300, "言語" * 120, "a" * 30, "b"]
    want = np.array([brute_log_score(w, p, pieces) for w in words])
    assert np.allclose(model.word_scores(words, pieces), want)
    monkeypatch.setattr(language_id, "STRETCH", 70)
    assert np.allclose(model.word_scores(words, pieces), want)


def test_expected_counts_are_slopes_of_the_score():
    """The expected number of uses of a piece is the slope of the log score by the logarithm of its probability."""
    pieces = language_id.shared_pieces()
    words, counts = ["theory", "theorytheorytheorytheorytheorytheory", "house"], np.array([2.0, 3.0, 1.0])
    p = np.append(np.random.default_rng(3).random(pieces.n) / 5000, 0)
    got = language_id.expected_counts(words, counts, p, pieces)
    total = lambda q: sum(c * brute_log_score(w, q[:, None], pieces)[0] for w, c in zip(words, counts, strict=True))
    used = np.flatnonzero(got)
    assert len(used) > 10
    for piece in used[:: max(1, len(used) // 12)]:
        up, down = p.copy(), p.copy()
        up[piece] *= 1 + 1e-4
        down[piece] *= 1 - 1e-4
        assert np.isclose((total(up) - total(down)) / 2e-4, got[piece], rtol=1e-4, atol=1e-8)


def test_fit_counts_of_long_words_are_those_of_the_whole_word(monkeypatch):
    pieces = language_id.shared_pieces()
    p = np.append(np.random.default_rng(4).random(pieces.n) / 5000, 0)
    words, counts = ["theoryofcomputation" * 11, "q" * 200, "言語" * 90 + "das", "haus"], np.array([1.0, 2.0, 3.0, 1.0])
    want = language_id.expected_counts(words, counts, p, pieces)
    monkeypatch.setattr(language_id, "BESIDE", 40)
    for stretch in (70, 4096):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        assert np.allclose(language_id.expected_counts(words, counts, p, pieces), want, atol=1e-12)


def test_language_query_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    rows = language_id.op9_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.95


def test_language_edges(spark):
    model = language_id.train(spark.createDataFrame([(1, "the house and the garden", "en"), (2, "das Haus und der Garten", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(edge_docs(spark), model).collect()}
    assert len(got) == 7 and all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 6)) and got[3].lang == "en"
    nothing = language_id.predict(edge_docs(spark), language_id.fit({}, language_id.shared_pieces()))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language_id.predict(edge_docs(spark).limit(0), model).count() == 0


# --- quality -----------------------------------------------------------------
def test_quality_orders_grades_on_held_out_rows():
    rng = np.random.default_rng(4)
    common = [f"c{k}" for k in range(200)]
    mark = {0: ["awful", "nasty"], 1: ["|", "spam"], 2: ["fine", "clear"]}
    texts, grades = [], rng.integers(0, 3, 600)
    for g in grades:
        texts.append(" ".join([*rng.choice(common, 30), *rng.choice(mark[int(g)], 2)]))
    rows = [quality.features(t) for t in texts]
    model = quality.fit(rows[:400], grades[:400])
    expected = np.array([model.tails(r).sum() for r in rows[400:]])
    means = [expected[grades[400:] == g].mean() for g in range(3)]
    assert means[0] < 0.4 < 0.7 < means[1] < 1.4 < 1.6 < means[2] and np.all(np.diff(model.thresholds) > 0)


def test_quality_query_on_held_out_labels(spark):
    """Fitted on three quarters of the labels of sf0.1, asked for the rest."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~held))
    asked = labels.where(held).select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    rows = quality.predict(docs.join(F.broadcast(asked), "doc_id"), model).select("grade", "expected_grade", "tail_probability").collect()
    grade = np.array([r.grade for r in rows])
    expected, tail = np.array([r.expected_grade for r in rows]), np.array([r.tail_probability for r in rows])
    means = [expected[grade == g].mean() for g in range(3)]
    assert means[0] + 0.2 < means[1] and means[1] + 0.3 < means[2]
    good, rest = tail[grade == 2], tail[grade < 2]
    assert np.mean(good[:, None] > rest[None, :]) > 0.93 and abs(tail.mean() - np.mean(grade == 2)) < 0.03


def test_quality_edges(spark):
    docs = edge_docs(spark)
    empty = quality.train(docs, spark.createDataFrame([(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"))
    got = quality.predict(docs, empty).collect()
    assert len(got) == len(EDGES) and all(r.kept for r in got)
    model = quality.train(docs, spark.createDataFrame([(3, 1, 0), (4, 0, None), (5, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int"))
    assert quality.predict(docs, model).count() == len(EDGES) and quality.predict(docs.limit(0), model).count() == 0


# --- personal data -----------------------------------------------------------
def brute_pii(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for k, c in enumerate(reversed(d)):
            n = int(c) * (1 + k % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m[0])]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


def test_pii_base_spans_match_brute_force(spark, sf_dir):
    texts = dict(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    for r in pii.op6_pii(spark, sf_dir).collect():
        want = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in pii.KINDS)
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_skip_edges_carry_a_label_across_the_document():
    texts = [f"call +1 (487) 555-72{k:02d} or x{k}@mail.example.com soon, item {k} of {k + 7} and 10.0.{k}.1" for k in range(60)]
    field = pii.fit([(pii.graph(t), pii.node_labels(pii.graph(t), pii.base_spans(t))) for t in texts])
    assert np.all(np.diag(field.skip)[1:] > 0)
    g = pii.graph("first 4929348385146306 then far away 4929348385146306 end")
    assert g.skip.tolist() == [[0, 1]] and g.chain.tolist() == []
    beliefs = field.beliefs(g)
    assert np.allclose(beliefs[0], beliefs[1]) and np.allclose(beliefs.sum(1), 1)
    one = pii.Field(field.unary, field.chain, np.zeros_like(field.skip))
    assert not np.allclose(one.beliefs(g), beliefs)


@pytest.fixture(scope="module")
def pii_field(spark, sf_dir):
    return pii.train(table(spark, sf_dir, "documents"))


def test_mentions_are_labelled_alike(pii_field):
    def added(text):
        return [(k, text[s:e]) for k, s, e in pii.added_spans(text, pii.base_spans(text), pii_field)]

    assert added("4915112345678 was called; see +4915112345678, +4915112345678 and +4915112345678") == [("phone", "4915112345678")]
    assert added("Call +1 415 555 0132 today. Later 14155550132 rang, and 1 415 555 0132 too.") == [("phone", "14155550132"), ("phone", "1 415 555 0132")]
    assert added("far 4929348385146306 " + "word " * 5000 + "4929-3483.8514-6306") == [("card", "4929-3483.8514-6306")]
    assert added("4915112345678 and " * 40 + "at last +4915112345678") == [("phone", "4915112345678")] * 40
    # a part of a longer span is no mention, and what no base span resembles stays
    assert added("card 4929 3483 8514 6306, order 34838514 and 20240115, 20240115") == []
    assert added("order 1234567 of 1234567, see 1234567") == []


def test_field_restores_hidden_labels_by_its_skip_edges(pii_field):
    rng = random.Random(8)
    samples = []
    for _ in range(60):
        number, mail = f"+{rng.randrange(10**11, 10**12)}", f"u{rng.randrange(10**6, 10**7)}@corp.example"
        text = " then ".join(rng.choice([number, mail, f"item {rng.randrange(99)}"]) for _ in range(8))
        found = pii.base_spans(text)
        g = pii.graph(text, found)
        if g is not None:
            samples.append((g, pii.node_labels(g, found)))
    hidden, restored, alone = pii.recovery(samples, pii_field)
    print(f"hidden {hidden}, restored {restored}, by the chain alone {alone}")
    assert hidden > 100 and restored > 0.9 * hidden and alone < 0.2 * hidden


def test_many_equal_candidates_take_bounded_time(pii_field):
    start = time.monotonic()
    text = "see +4915112345678; " + "or 4915112345678 " * 30_000
    assert len(pii.added_spans(text, pii.base_spans(text), pii_field)) == 30_000
    assert time.monotonic() - start < 60


def test_pii_edges(spark):
    got = pii.scan(edge_docs(spark), pii.train(edge_docs(spark))).collect()
    assert len(got) == len(EDGES) and all(r.pii_spans == [] for r in got)
    assert pii.scan(edge_docs(spark).limit(0), None).count() == 0 and pii.train(edge_docs(spark).limit(0)) is None
    assert pii.base_spans("1" * 5000 + ".1.1.1") == []


def test_pii_patterns_on_random_and_very_long_texts():
    rng = random.Random(1)
    parts = ["a", "b.", "@", "@", "1", "255", ".", "-", "_", "é", "%", " ", "+1", "(", "000"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 22)))
        assert [f"{k}:{s}:{e}" for k, s, e in sorted(pii.base_spans(text), key=lambda s: (s[1], pii.RANK[s[0]]))] == brute_pii(text)
    start = time.monotonic()
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "a@" * 500_000, "1." * 500_000, "+1" * 500_000):
        pii.base_spans(text)
    assert time.monotonic() - start < 10


def test_messages_on_a_tree_equal_enumeration():
    rng = np.random.default_rng(6)
    k = len(pii.LABELS)
    skip = rng.normal(size=(k, k))
    field = pii.Field(rng.normal(size=(pii.WIDTH, k)), rng.normal(size=(k, k)), (skip + skip.T) / 2)
    g = pii.Graph([(n, n + 1) for n in range(5)], rng.integers(0, pii.WIDTH, (5, 3)), np.array([[0, 1], [3, 4]]), np.array([[0, 2], [1, 4]]))
    own = field.unary[g.features].sum(1)
    want = np.zeros((5, k))
    for labels in itertools.product(range(k), repeat=5):
        score = sum(own[n, y] for n, y in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in g.chain) + sum(field.skip[labels[a], labels[b]] for a, b in g.skip)
        want[np.arange(5), labels] += np.exp(score)
    monkey = pii.ROUNDS
    try:
        pii.ROUNDS = 60
        assert np.allclose(field.beliefs(g), want / want.sum(1, keepdims=True), atol=1e-6)
    finally:
        pii.ROUNDS = monkey


# --- licences ----------------------------------------------------------------
@pytest.fixture(scope="module")
def licences(spark, sf_dir):
    return license_scan.train(table(spark, sf_dir, "documents"))


def test_licence_query_finds_notices_and_nothing_else(spark, sf_dir, licences):
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()]
    family = {"Apache License": "apache", "MIT License": "mit", "CC BY-NC": "cc-by-nc", "GNU General": "gpl"}
    for t in texts:
        want = [f for line in t.split("\n") for words, f in family.items() if words in line]
        assert [f for f, *_ in licences.scan(t)[0]] == want


def test_licence_variants_and_lookalikes(licences):
    assert licences.classify("SOURCE: licensed under the apache license version 2.0 (see file)")[0] == "apache"
    assert licences.classify("Permission is hereby granted, free of charge, to any person obtaining a copy of this software")[0] == "mit"
    for text in (*license_scan.LOOKALIKES, "", "The house was free and in the public park"):
        assert licences.classify(text)[0] == license_scan.UNKNOWN


def test_licence_short_and_wrapped_notices(spark, licences):
    bare = "Some words of a page.\nAll rights reserved."
    bsd = "# Redistribution and use in source and binary forms, with or without modification,\n# are permitted provided that the following conditions are met"
    gpl = "This program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free\nSoftware Foundation."
    torn = gpl.replace("\n", "\n\n", 1)
    rows = spark.createDataFrame([(1, bare), (2, f"x\n\n{bsd}\n\ny"), (3, f"int main() {{\n{gpl}\nreturn nothing"), (4, torn)], "doc_id long, text string")
    got = {r.doc_id: (r.n_paragraphs, [(s.family, r.text[s.start : s.end]) for s in r.licenses]) for r in license_scan.scan(rows, licences).collect()}
    assert got == {1: (1, [("reserved", "All rights reserved.")]), 2: (3, [("bsd", bsd)]), 3: (1, [("gpl", gpl)]), 4: (2, [])}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
OTHERS = {
    "agpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation.",
    "lgpl": "This library is free software; you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published\nby the Free Software Foundation.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
}


def test_licence_whole_headers_are_one_span(licences):
    for family, notice in {"mit": MIT, "apache": APACHE, **OTHERS}.items():
        text = f"some words before\n\n{notice}\n\nand some words after"
        assert [(f, text[s:e]) for f, s, e, _ in licences.scan(text)[0]] == [(family, notice)], family


def test_licence_slopes_equal_differences():
    """The classifier's fit follows the slope of its loss: a step along it lowers the loss as differences say."""
    model = license_scan.fit(["plain words of a page", "other words here and there"])
    words = license_scan.words_of(license_scan.NOTICES["mit"][1])
    at = [model.place[g] for g in license_scan.grams(words) if g in model.place]
    y = model.families.index("mit")

    def loss(w):
        score = w[at].sum(0) + model.bias
        return float(np.log(np.exp(score - score.max()).sum()) + score.max() - score[y])

    score = model.weights[at].sum(0) + model.bias
    p = np.exp(score - score.max())
    p /= p.sum()
    for c in (y, 0, len(model.families) - 1):
        up, down = model.weights.copy(), model.weights.copy()
        up[at[0], c] += 1e-5
        down[at[0], c] -= 1e-5
        assert np.isclose((loss(up) - loss(down)) / 2e-5, p[c] - (c == y), atol=1e-6)
    assert model.predict(words)[0] == "mit" and 0.3 <= model.temperature <= 4


def test_licence_query_reports_every_reservation(spark, sf_dir, licences):
    for r in license_scan.scan(table(spark, sf_dir, "documents"), licences).collect():
        assert sum(s.family == "reserved" for s in r.licenses) == (r.text or "").split("\n").count("All rights reserved.")


def test_licence_groups_equal_brute_force(licences):
    rng, vocabulary = random.Random(5), [w for n in license_scan.NOTICES["gpl"] + license_scan.NOTICES["mit"] for w in license_scan.words_of(n)]
    for _ in range(60):
        lines = [[rng.choice(vocabulary) if rng.random() < 0.3 else "x" for _ in range(rng.randrange(5))] for _ in range(3)]
        whole = license_scan.words_of(rng.choice(license_scan.NOTICES["gpl"]))
        cuts = sorted(rng.randrange(len(whole) + 1) for _ in range(2))
        lines += [whole[: cuts[0]], whole[cuts[0] : cuts[1]], [], whole[cuts[1] :]]
        want = set()
        for family, templates in license_scan.TEMPLATES.items():
            for t in templates:
                full = [(i, j) for i in range(len(lines)) for j in range(i, len(lines)) if len(license_scan.pairs([w for line in lines[i : j + 1] for w in line]) & t) / len(t) >= license_scan.MIN_SHARE]
                want |= {(i, j, family, frozenset(t)) for i, j in full if not any((a, b) != (i, j) and i <= a and b <= j for a, b in full)}
        assert set(license_scan.least_groups(lines, license_scan.LICENCES)) == want


def test_licence_edges(spark, licences):
    got = license_scan.scan(edge_docs(spark), licences).collect()
    assert len(got) == len(EDGES) and all(r.licenses == [] for r in got)
    assert {r.doc_id: r.n_paragraphs for r in got}[6] == 1 and license_scan.scan(edge_docs(spark).limit(0), licences).count() == 0


def test_notices_are_confirmed_in_order(licences):
    torn = "The MIT Museum released the film under a new title. Software was released under the table."
    assert licences.scan(torn)[0] == []
    for text, family in (("SPDX-License-Identifier: BSD-2-Clause", "bsd"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("Licensed under GPLv3", "gpl"), ("License: MIT", "mit"), ("Distributed under the Boost Software License, Version 1.0.", "boost")):
        assert [h[0] for h in licences.scan(text)[0]] == [family], text
    notice = license_scan.words_of(license_scan.NOTICES["mit"][1])
    assert license_scan.alignment(notice, notice) == len(notice)
    assert license_scan.alignment(notice[:5] + ["x"] + notice[5:], notice) == len(notice) - 0.5
    assert not license_scan.in_order(notice[::-1], frozenset(license_scan.pairs(notice)))


def test_background_is_drawn_from_whole_lines():
    long = " ".join(f"w{k}" for k in range(1000))
    assert sum(len(p.split()) for p in license_scan.some_lines(long)) == 1000
