"""Operator 5: quality selection by ordinal cumulative-link regression.

Grades are ordered: 0 toxic, 1 poor, 2 good. All share one weight for each hashed feature
of the text; ordered thresholds cut the summed weights into grades:
P(grade >= k) = logistic(weights . features - threshold_k). So one score gives the expected
grade and, as tail probability P(grade >= 2), what selection goes by.

Features are hashes (32 bits) of the text's distinct words without outer punctuation, and
of its form: shares of letters, capitals, marks, repeated words and lines, in steps. Only
features of at least MIN_DOCS training documents get a weight, so a model is a short list
and a hash that no training document had adds nothing.

The model is fitted on a sample of about SAMPLE labelled documents, drawn by a hash of the
id; predicting reads every whole text.

Cases: a null text counts as empty; rows with a null id, quality and toxic flag are not
trained on, a null flag counts as 0 beside one that is set; a document labelled twice is
used twice; with no labelled rows every document gets equal odds of all grades and is kept;
repeated rows are scored each; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.common import append_columns, table

GRADES = 3
#: Labelled documents that the model is fitted on, about; training documents a feature needs.
SAMPLE = 12000
MIN_DOCS = 8
STEPS = 250
#: Further steps in which the thresholds alone are fitted, with all rows counting alike.
CALIBRATION = 80
PENALTY = 5e-4
#: Power of a grade's share by which rarer grades count more in the fit of the weights.
BALANCE = 0.5
#: A document is kept if its tail probability P(grade >= 2) reaches this.
MIN_TAIL = 0.5

_EDGE = ".,;:!?|\"'()[]{}#$%&*-_<>/\\=+~`^"
_LETTERS = re.compile(r"[^\W\d_]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARKS = re.compile(r"[#$%&*|!<>{}~^=]")


def forms(text: str, words: list[str]) -> list[str]:
    """Names of the text's form features."""
    n = max(1, len(text))
    step = lambda share: min(9, int(10 * share))
    letters = len(_LETTERS.findall(text))
    lines = text.split("\n")
    found = [
        f"\0letters {step(letters / n)}",
        f"\0capitals {step(len(_CAPITALS.findall(text)) / max(1, letters))}",
        f"\0marks {min(9, int(50 * len(_MARKS.findall(text)) / n))}",
        f"\0words again {step(1 - len(set(words)) / max(1, len(words)))}",
        f"\0lines again {step(1 - len(set(lines)) / len(lines))}",
        f"\0size {len(text).bit_length()}",
    ]
    return found


def features(text: str | None) -> np.ndarray:
    """Distinct feature hashes of the whole text."""
    text = text or ""
    words = text.lower().split()
    own = {w.strip(_EDGE) for w in set(words)}
    own.update(forms(text, words))
    return np.fromiter(map(xxhash.xxh32_intdigest, own), np.uint32, len(own))


@dataclass
class Model:
    """Feature hashes in ascending order, their weights, and the ascending thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, own: np.ndarray) -> float:
        if not len(self.hashes):
            return 0.0
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return float(self.weights[at][self.hashes[at] == own].sum())

    def tails(self, own: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.score(own), -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Adam on the likelihood of the grades with a quadratic penalty; thresholds stay ordered by their steps' logarithms."""
    even = np.log(np.arange(1, GRADES) / (GRADES - np.arange(1, GRADES)))
    if not rows:
        return Model(np.zeros(0, np.uint32), np.zeros(0), even)
    flat = np.concatenate(rows)
    hashes, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
    used = counts >= MIN_DOCS
    place = (np.cumsum(used) - 1).astype(np.int32)
    keep = used[index]
    column = place[index[keep]]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[keep]
    n, m = len(rows), int(used.sum())
    del flat, index, keep
    w, free = np.zeros(m), np.array([even[0], *np.log(np.diff(even))])
    moments = [np.zeros(m + len(free)), np.zeros(m + len(free))]
    share = np.bincount(grades, minlength=GRADES) / n
    importance = (np.maximum(share, 1e-9) ** -BALANCE)[grades]
    importance /= importance.sum()
    rate = 0.05
    for step in range(1, STEPS + CALIBRATION + 1):
        if step == STEPS + 1:
            # the weights stay; the thresholds go on with all rows counting alike, so that tails are shares again
            importance = np.full(n, 1 / n)
            moments = [np.zeros_like(m_) for m_ in moments]
        thresholds = np.cumsum(np.append(free[0], np.exp(free[1:])))
        score = np.bincount(doc, w[column], n)
        # P(grade >= k) with 1 below and 0 above
        tail = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -500, 500)))
        edges = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
        slope = edges * (1 - edges)
        lower, upper = edges[np.arange(n), grades], edges[np.arange(n), grades + 1]
        likelihood = np.maximum(lower - upper, 1e-12)
        by_lower = importance * slope[np.arange(n), grades] / likelihood
        by_upper = importance * slope[np.arange(n), grades + 1] / likelihood
        toward = by_lower - by_upper
        at = np.zeros(GRADES + 1)
        np.add.at(at, grades, by_lower)
        np.add.at(at, grades + 1, -by_upper)
        by_threshold = at[1:GRADES]
        own = np.concatenate([-np.bincount(column, toward[doc], m) + PENALTY * w, [by_threshold.sum()], [by_threshold[k:].sum() * np.exp(free[k]) for k in range(1, GRADES - 1)]])
        moments[0] = 0.9 * moments[0] + 0.1 * own
        moments[1] = 0.999 * moments[1] + 0.001 * own**2
        turn = step if step <= STEPS else step - STEPS
        change = rate * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.999**turn)) + 1e-8)
        free = free - change[m:]
        if step <= STEPS:
            w = w - change[:m]
    return Model(hashes[used], w, np.cumsum(np.append(free[0], np.exp(free[1:]))))


def grade_of(quality: Column, toxic: Column) -> Column:
    return F.when(F.coalesce(toxic, F.lit(0)) == 1, 0).when(F.coalesce(quality, F.lit(0)) == 1, 2).otherwise(1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents; labels have ``id_col``, quality and toxic."""
    usable = labels.where(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    n = usable.count()
    scale = 1 << 30
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("quality"), F.col(id_col)), F.lit(scale)) < int(min(1.0, sample / max(1, n)) * scale))
    graded = drawn.select(id_col, grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    texts = docs.select(id_col, F.col(text_col).alias("text")).where(F.col(id_col).isNotNull())
    # the sample is bounded, so it may be broadcast
    joined = texts.join(F.broadcast(graded), id_col).select("grade", "text")
    rows = append_columns(joined, ["text"], "hashes binary", lambda: lambda t: [[features(x).astype("<u4").tobytes() for x in t]])
    got = sorted((int(g), bytes(h)) for g, h in rows.select("grade", "hashes").collect())
    return fit([np.frombuffer(h, "<u4") for _, h in got], np.array([g for g, _ in got], np.int64))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with expected_grade (0 to 2), tail_probability (of the best grade) and kept."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(texts):
            tails = [shared.value.tails(features(t)) for t in texts]
            return [[float(t.sum()) for t in tails], [float(t[-1]) for t in tails], [bool(t[-1] >= MIN_TAIL) if len(shared.value.hashes) else True for t in tails]]

        return step

    return append_columns(df, [text_col], "expected_grade double, tail_probability double, kept boolean", make)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document with its expected grade, tail probability and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return predict(docs, model).drop("text")
