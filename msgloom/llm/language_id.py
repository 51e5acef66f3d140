"""Operator 9: language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary, all of them, in lower case as the texts are, get a
probability in each language. The probability of a word (a run of letters of any length) is
the sum over all ways to cut it into pieces of the product of their probabilities, which a
forward pass finds; that of a text is the product over its words. Short words go through
it side by side; longer ones by a pass that rescales as it goes and holds a bounded stretch.
The probabilities are fitted by expectation maximisation (forward and backward passes) on
word counts of a sample of labelled rows: about SAMPLE documents of each language, drawn by
a hash of the id. Words are never cut there either. Word counting for the sample runs in
Spark; what reaches the driver is bounded by the sample. The model holds one probability a
piece and language.

Predicting looks at every letter run of the whole text and uses no other column.

Cases: a null text, or one without a letter, gets ``und`` and score 0; a language without
sampled text is not learned; with nothing learned all get ``und``; equal scores go to the
language that sorts first; repeated rows count as often as they occur; rows with a null id
are never trained on; an empty table gives no rows; extra columns stay,
but those named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.common import append_columns, table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Documents a language that the model is fitted on, about; rounds of fitting; words a worker remembers.
SAMPLE = 800
ROUNDS = 2
MEMO_WORDS = 150_000
UNKNOWN = "und"
#: Letters of a word that needs no rescaling, of one fitted side by side with others, stretch of a longer one held at once.
SHORT = 30
BESIDE = 256
STRETCH = 4096
#: Languages up to which their sampling rates may be broadcast (some bytes each); else they are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
#: Probability of a character outside all pieces.
FLOOR = 1e-8
SMOOTH = 0.1

_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = np.uint64((1 << 18) - 1)


def words_of(text: str | None) -> list[str]:
    """Letter runs in lower case."""
    return _WORD.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


class Pieces:
    """The vocabulary's pieces by hash, to find all pieces in many words at once. Pieces that differ in case only are one."""

    def __init__(self, path: str = VOCABULARY) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {model.id_to_piece(k).lower() for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
        texts = sorted(texts)
        self.n, self.longest = len(texts), max(map(len, texts))
        self.hashes = np.array([self._hash(t) for t in texts], np.uint64)
        # a table by some bits of the hash; pieces that find their place taken go to one by other bits, and so on
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(self.n, dtype=np.int32)
        while len(left):
            shift = np.uint64(5 + 19 * (len(self.tables) % 2) + len(self.tables) // 2)
            slots = (self.hashes[left] >> shift) & _SLOTS
            _, first = np.unique(slots, return_index=True)
            table = np.full(int(_SLOTS) + 1, -1, np.int32)
            table[slots[first]] = left[first]
            self.tables.append((shift, table))
            left = np.delete(left, first)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h + ord(c) + 1) * int(_MULTIPLIER) & (1 << 64) - 1
            h ^= h >> 29
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(hashes.shape, -1, np.int32)
        for shift, table in self.tables:
            got = table[(hashes >> shift) & _SLOTS]
            np.copyto(out, got, where=(got >= 0) & (self.hashes[got] == hashes))
        return out

    def arcs(self, words: list[str], start: int = 0, length: int | None = None) -> np.ndarray:
        """arcs[w, i, l - 1]: the piece of l characters that starts at start + i in word w (with its word mark), or -1; ``length`` places, all unless given."""
        width = 1 + max(map(len, words)) - start if length is None else length
        ahead = width if length is None else width + self.longest - 1
        codes = np.zeros((len(words), ahead), np.uint64)
        for k, word in enumerate(words):
            shown = ("\u2581" + word[:ahead])[:ahead] if start == 0 else word[start - 1 : start - 1 + ahead]
            codes[k, : len(shown)] = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), "<u4")
        there = codes > 0
        codes += there
        out = np.full((len(words), width, self.longest), -1, np.int32)
        with np.errstate(over="ignore"):
            running = np.zeros_like(codes)
            for l in range(1, min(self.longest, ahead) + 1):
                reach = ahead - l + 1
                running = (running[:, :reach] + codes[:, l - 1 :]) * _MULTIPLIER
                running ^= running >> np.uint64(29)
                reach = min(reach, width)
                found = self.find(running[:, :reach])
                out[:, :reach, l - 1] = np.where(there[:, l - 1 : l - 1 + reach], found, -1)
        return out


@dataclass
class Model:
    """Languages in ascending order and, for each, the probabilities of all pieces; the last row is for no piece."""

    languages: list[str]
    probabilities: np.ndarray

    def word_scores(self, words: list[str], pieces: Pieces) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(words), len(self.languages)))
        for start in range(0, len(words), 4096):
            part = words[start : start + 4096]
            sizes = np.array([len(w) for w in part])
            order = np.argsort(sizes, kind="stable")
            short = order[sizes[order] <= SHORT]
            for rows in np.array_split(short, 1 + len(short) // 512):
                if len(rows):
                    chosen = [part[r] for r in rows]
                    alpha = forward(pieces.arcs(chosen), self.probabilities)
                    out[start + rows] = np.log(alpha[np.arange(len(rows)), [1 + len(w) for w in chosen]])
            long = order[len(short) :]
            for rows in np.array_split(long, 1 + len(long) // 32):
                if len(rows):
                    out[start + rows] = long_scores([part[r] for r in rows], self.probabilities, pieces)
        return out


def long_scores(words: list[str], probabilities: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log probability of each word, of any length, in each language.

    The forward pass goes over stretches of the words; what it carries on, the sums at the
    next places that pieces may reach, is divided by its largest every few characters, for
    each word and language by itself.
    """
    sizes = np.array([1 + len(w) for w in words])
    n, ahead = len(words), pieces.longest
    out, scale = np.empty((n, probabilities.shape[1])), np.zeros((n, probabilities.shape[1]))
    carried = np.zeros((n, ahead + 1, probabilities.shape[1]))
    carried[:, 0] = 1
    start, stretch = 0, max(64, STRETCH // n)
    while start < sizes.max():
        length = int(min(stretch, sizes.max() - start))
        arcs = pieces.arcs(words, start, length)
        alpha = np.zeros((n, length + ahead + 1, probabilities.shape[1]))
        alpha[:, : ahead + 1] = carried
        for at in range(length):
            if at % 8 == 0:
                top = alpha[:, at : at + ahead + 1].max(1)
                top[top == 0] = 1
                alpha[:, at : at + ahead + 1] /= top[:, None]
                scale += np.log(top)
            alpha[:, at + 1] += FLOOR * alpha[:, at]
            for l in range(1, ahead + 1):
                rows = np.flatnonzero(arcs[:, at, l - 1] >= 0)
                if len(rows):
                    alpha[rows, at + l] += alpha[rows, at] * probabilities[arcs[rows, at, l - 1]]
            ends = np.flatnonzero(sizes == start + at + 1)
            if len(ends):
                out[ends] = np.log(alpha[ends, at + 1]) + scale[ends]
        carried = alpha[:, length : length + ahead + 1]
        start += length
    return out


def forward(arcs: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """alpha[w, i]: the probability of the first i characters, summed over all segmentations."""
    n, width, most = arcs.shape
    alpha = np.zeros((n, width + 1, probabilities.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, width + 1):
        alpha[:, end] = FLOOR * alpha[:, end - 1]
        for l in range(1, min(end, most) + 1):
            piece = arcs[:, end - l, l - 1]
            rows = np.flatnonzero(piece >= 0)
            if len(rows):
                alpha[rows, end] += alpha[rows, end - l] * probabilities[piece[rows]]
    return alpha


def log_lattice(arcs: np.ndarray, log_p: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the forward and backward sums of one language, for words of any length."""
    n, width, most = arcs.shape
    weight = np.where(arcs >= 0, log_p[arcs], -np.inf)
    alpha, beta = np.full((n, width + 1), -np.inf), np.full((n, width + 1), -np.inf)
    alpha[:, 0] = 0
    for end in range(1, width + 1):
        terms = [alpha[:, end - 1] + math.log(FLOOR)] + [alpha[:, end - l] + weight[:, end - l, l - 1] for l in range(1, min(end, most) + 1)]
        alpha[:, end] = np.logaddexp.reduce(terms)
    beta[np.arange(n), ends] = 0
    for start in range(width - 1, -1, -1):
        terms = [beta[:, start], beta[:, start + 1] + math.log(FLOOR)] + [beta[:, start + l] + weight[:, start, l - 1] for l in range(1, min(most, width - start) + 1)]
        beta[:, start] = np.logaddexp.reduce(terms)
    return alpha, beta


def sums_in_stretch(before: list[float], arcs: list[list[tuple[int, float]]]) -> tuple[list[float], list[float]]:
    """Logarithms of the sums at each place of a stretch, and what it carries on.

    ``before`` holds the logarithms at the next places that earlier pieces reach, ``arcs``
    for each place the lengths and probabilities of the pieces that begin there.
    """
    ahead = len(before)
    out: list[float] = []
    scale = max(before)
    window = [math.exp(x - scale) for x in before]
    for found in arcs:
        here = window[0]
        out.append(math.log(here) + scale)
        window = [*window[1:], 0.0]
        window[0] += FLOOR * here
        for length, weight in found:
            window[length - 1] += weight * here
        if len(out) % 8 == 0:
            top = max(window)
            scale += math.log(top)
            window = [x / top for x in window]
    return out, [math.log(x) + scale if x > 0 else -math.inf for x in window[:ahead]]


def counts_in_stretches(word: str, p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in one word of any length: a stretch of its pieces is held at a time, and two sums a place."""
    total, n, ahead = np.zeros(len(p)), 1 + len(word), pieces.longest
    starts = range(0, n, STRETCH)

    def found(start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        size = min(STRETCH, n - start)
        arcs = pieces.arcs([word], start, size)[0]
        at, length = np.nonzero(arcs >= 0)
        return start + at, length + 1, arcs[at, length], size

    def by_place(places: np.ndarray, lengths: np.ndarray, ids: np.ndarray, first: int, size: int) -> list[list[tuple[int, float]]]:
        out: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for place, length, weight in zip((places - first).tolist(), lengths.tolist(), p[ids].tolist(), strict=True):
            out[place].append((length, weight))
        return out

    alpha = np.full(n + ahead + 1, -np.inf)
    carried = [0.0] + [-math.inf] * ahead
    for start in starts:
        places, lengths, ids, size = found(start)
        alpha[start : start + size], carried = sums_in_stretch(carried, by_place(places, lengths, ids, start, size))
    alpha[n] = carried[0]
    beta = np.full(n + ahead + 1, -np.inf)
    beta[n] = 0.0
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    for start in reversed(starts):
        places, lengths, ids, size = found(start)
        grouped = by_place(places, lengths, ids, start, size)
        window = beta[start + size : start + size + ahead].tolist()
        scale = max(window)
        near = [math.exp(x - scale) for x in window]
        for k in range(size - 1, -1, -1):
            here = FLOOR * near[0] + sum(weight * near[length - 1] for length, weight in grouped[k])
            beta[start + k] = math.log(here) + scale
            near = [here, *near[:-1]]
            if k % 8 == 0:
                top = max(near)
                scale += math.log(top)
                near = [x / top for x in near]
        total += np.bincount(ids, np.exp(alpha[places] + log_p[ids] + beta[places + lengths] - alpha[n]), len(p))
    return total


def expected_counts(words: list[str], counts: np.ndarray, p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in the words under the probabilities ``p`` of one language."""
    total = np.zeros(len(p))
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    short = order[sizes[order] <= SHORT]
    long = order[(sizes[order] > SHORT) & (sizes[order] <= BESIDE)]
    for row in order[sizes[order] > BESIDE]:
        total += counts[row] * counts_in_stretches(words[row], p, pieces)
    for rows in [*np.array_split(short, 1 + len(short) // 2048), *np.array_split(long, 1 + len(long) // 256)]:
        if not len(rows):
            continue
        chosen = [words[r] for r in rows]
        arcs = pieces.arcs(chosen)
        n, width, most = arcs.shape
        ends = np.array([1 + len(w) for w in chosen])
        places = np.arange(n)
        if sizes[rows[-1]] > SHORT:
            alpha, beta = log_lattice(arcs, log_p, ends)
            whole = alpha[places, ends]
            for l in range(1, min(most, width) + 1):
                piece = arcs[:, : width - l + 1, l - 1]
                hit = piece >= 0
                weight = np.exp(alpha[:, : width - l + 1] + log_p[piece] + beta[:, l : width + 1] - whole[:, None]) * counts[rows][:, None]
                total += np.bincount(piece[hit], weight[hit], len(p))
            continue
        alpha = forward(arcs, p[:, None])[:, :, 0]
        beta = np.zeros((n, width + 1))
        beta[places, ends] = 1
        for start in range(width - 1, -1, -1):
            beta[:, start] += FLOOR * beta[:, start + 1]
            for l in range(1, min(most, width - start) + 1):
                piece = arcs[:, start, l - 1]
                beta[:, start] += np.where(piece >= 0, p[piece] * beta[:, start + l], 0)
        share = counts[rows] / alpha[places, ends]
        for l in range(1, min(most, width) + 1):
            piece = arcs[:, : width - l + 1, l - 1]
            hit = piece >= 0
            weight = alpha[:, : width - l + 1] * p[piece] * beta[:, l : width + 1] * share[:, None]
            total += np.bincount(piece[hit], weight[hit], len(p))
    return total


def fit(counted: dict[str, dict[str, int]], pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from word counts of each language."""
    languages = sorted(k for k, words in counted.items() if words)
    columns = []
    for language in languages:
        words = list(counted[language])
        counts = np.array([counted[language][w] for w in words], float)
        p = np.append(np.full(pieces.n, 1 / pieces.n), 0)
        for _ in range(rounds):
            got = expected_counts(words, counts, p, pieces)[:-1] + SMOOTH
            p = np.append(got / got.sum(), 0)
        columns.append(p)
    return Model(languages, np.stack(columns, 1) if columns else np.zeros((pieces.n + 1, 0)))


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model:
    """A model from a hashed sample of about ``sample`` of the labelled documents of each language."""
    rows = labelled.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    scale = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(scale))
    rates = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.ceil(F.least(F.lit(1.0), F.lit(sample) / F.count("*")) * scale).alias("rate"))
    if rates.count() <= BROADCAST_LANGUAGES:
        rates = F.broadcast(rates)
    drawn = rows.select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).alias("text")).join(rates, "lang").where("draw < rate")
    one = append_columns(drawn.select("lang", "text"), ["text"], "words array<string>", lambda: lambda texts: [[words_of(t) for t in texts]])
    counts = one.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count()
    counted: dict[str, dict[str, int]] = {}
    for lang, word, n in counts.collect():
        counted.setdefault(lang, {})[word] = n
    return fit(counted, Pieces())


_PIECES: dict[str, Pieces] = {}


def shared_pieces(path: str = VOCABULARY) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


class Scorer:
    """Scores whole texts with a memory of word scores, which starts afresh when it is full."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces = model, shared_pieces()
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.empty((1 << 14, len(self.model.languages)))

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.place))
        if len(self.place) + len(new) > MEMO_WORDS:
            self.clear()
            new = list(words)
        while len(self.place) + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        if new:
            start = len(self.place)
            self.scores[start : start + len(new)] = self.model.word_scores(new, self.pieces)
            self.place.update(zip(new, range(start, start + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        if self.model.languages:
            self.learn(set().union(*split))
        names, sure = [], []
        for words in split:
            if not self.model.languages or not has_letter(words):
                names.append(UNKNOWN)
                sure.append(0.0)
                continue
            total = self.scores[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(np.argmax(total))
            names.append(self.model.languages[best])
            sure.append(float(1 / np.exp(total - total[best]).sum()))
        return names, sure


def predict(df: DataFrame, model: Model, text_col: str = "text", into: str | None = None) -> DataFrame:
    """``df`` with lang_pred and score, the posterior of the predicted language under equal priors; with ``into`` as a struct of that name."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: list(scorer.predict(texts))

    return append_columns(df, [text_col], "lang_pred string, score double", make, into)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that are kept out of training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()), "doc_id", "text", "lang")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: whether it was held out, the predicted language and its score."""
    docs = table(spark, sf_dir, "documents")
    model = train_on_documents(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
