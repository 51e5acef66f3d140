"""Operator 6: personal data by a skip-chain conditional random field.

Four plain patterns give the base spans. A random field then labels the document's
candidate tokens (runs without white space that hold a digit or an at sign; all other
tokens are outside by definition): tokens side by side share a potential, and so do the
tokens of each mention, of the similar one before it and of the first similar one that a
base span covers (else the first at all), however far away. A mention is a candidate or up to MENTION neighbours of digits and marks; similar are
those of equal letters and digits, or equal digits, seven or more. Loopy message passing
spreads what is known of one mention to the others until the messages settle, so that a
number is labelled alike wherever the document repeats it.

Base spans are evidence: their tokens keep their labels. As the patterns passed over all
other tokens, features make no kind likelier than outside for them; but for a token that is
similar to another, no kind less likely by more than DOUBT (in logarithms) either. Tokens that the field is sure of,
outside the base spans, are added.

Potentials are fitted by pseudo-likelihood on a sample of about SAMPLE documents that have
candidates, NODES of them at most, drawn by a hash of the id, with the base spans as labels.
Tokens with similar ones count a second time with their features hidden, so the potentials
between similar tokens are learned from what these tell alone; before that, and without
evidence against it, similar tokens are expected to agree (AGREE). Their potential has one
weight for agreement, whatever the label, so a repeated token is no evidence by itself.

Cases: null text counts as empty; texts without candidates give no spans; repeated rows
are scanned each; rows with a null id are not trained on; with nothing to train on only
base spans are given; extra columns stay, but those named like a result are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.common import append_columns, table

KINDS = ("email", "ip", "card", "phone")
RANK = {kind: k for k, kind in enumerate(KINDS)}
LABELS = ("outside", *KINDS)
#: Documents fitted on, about; steps of the fit; share of belief needed to add a span.
SAMPLE = 1500
#: Candidates up to which a document may be in the sample, which bounds what reaches the driver.
NODES = 4000
STEPS = 150
#: Messages count as settled when none changes by more than SETTLED; rounds up to which loops that never settle go on.
SETTLED = 1e-6
ROUNDS = 200
SURE = 0.95
WIDTH = 1 << 12
#: The feature of a token whose own features are hidden.
HIDDEN = WIDTH
MENTION = 5
DOUBT = 2.0
AGREE = 6.0
#: Edges whose messages are computed at once.
BLOCK = 1 << 16

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match ends with its last digit, so one that starts within a run of digits would be none of the leftmost.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HOLDS = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_KEY = re.compile(r"[^0-9A-Za-z]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NUMBER = re.compile(r"[^\w@]*[0-9](?:[0-9]|[^\w@])*")
_EDGE = ".,;:!?|\"'()[]{}<>#$%&*"

Span = tuple[str, int, int]


def passes_luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[::-2])) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Addresses, found from each at sign to both sides, so that no run of letters is walked twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if domain:
            done = domain.end()
            yield ("email", start, done)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, in time linear in the text; matches that fail the kind's test are dropped."""
    found: list[Span] = list(emails(text))
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and passes_luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


@dataclass
class Graph:
    """Candidate tokens of a text, their feature numbers, and the edges between them."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def token_features(token: str) -> list[str]:
    digits = _NOT_DIGIT.sub("", token)
    n = len(digits)
    parts = token.strip(_EDGE).split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    host = token.rpartition("@")[2]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^0-9a@.+() -]", "x", re.sub(r"[0-9]", "0", re.sub(r"[A-Za-z]", "a", token))))
    return [
        "bias",
        f"digits {min(n, 20)}",
        f"quad {quad}",
        f"at {'@' in token} {'.' in host}",
        f"plus {token.lstrip(_EDGE).startswith('+')}",
        f"luhn {14 <= n <= 19 and passes_luhn(digits)}",
        f"letters {any(c.isalpha() for c in token)}",
        f"shape {shape[:12]}",
    ]


def links(one: range, other: range) -> Iterator[tuple[int, int]]:
    """Pairs of the tokens of two mentions by place, the last of the shorter with all that is left; none if the mentions overlap."""
    if one.stop <= other.start:
        for k in range(max(len(one), len(other))):
            yield one[min(k, len(one) - 1)], other[min(k, len(other) - 1)]


def wide(text: str, found: Iterable[Span]) -> list[tuple[int, int]]:
    """Stretches of the base spans that hold white space, in order; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for _, start, end in sorted(found, key=lambda s: s[1]):
        if re.search(r"\s", text[start:end]):
            if out and start < out[-1][1]:
                start, end = out[-1][0], max(end, out.pop()[1])
            out.append((start, end))
    return out


def graph(text: str, found: Iterable[Span] = ()) -> Graph | None:
    """None for a text without candidates. A base span of several tokens is one mention: its parts are similar to nothing."""
    if not _HOLDS.search(text):
        return None
    spans, rows, chain = [], [], []
    skip: set[tuple[int, int]] = set()
    met: dict[str, list[range]] = {}
    # digits of the run of neighbours without letters that ends here
    run: list[str] = []
    stretches = wide(text, found)
    at, first = 0, -1
    before, number = -2, 0
    for number, m in enumerate(_TOKEN.finditer(text)):
        token = m.group()
        if not _HOLDS.search(token):
            continue
        node = len(spans)
        spans.append(m.span())
        rows.append([zlib.crc32(f.encode()) % WIDTH for f in token_features(token)])
        if before == number - 1:
            chain.append((node - 1, node))
        else:
            run = []
        before = number
        digits = _NOT_DIGIT.sub("", token)
        run = [*run[1 - MENTION :], digits] if _NUMBER.fullmatch(token) else []
        keys = {_KEY.sub("", token).lower(): 1, digits: 1}
        while at < len(stretches) and stretches[at][1] <= m.start():
            at, first = at + 1, -1
        if at < len(stretches) and stretches[at][0] < m.end():
            first = node if first < 0 else first
            whole = _NOT_DIGIT.sub("", text[slice(*stretches[at])])
            keys, run = {whole: node + 1 - first} if m.end() >= stretches[at][1] else {}, []
        for size in range(2, len(run) + 1):
            keys.setdefault("".join(run[-size:]), size)
        for key, size in keys.items():
            if len(key) >= 7:
                mention = range(node + 1 - size, node + 1)
                others = met.setdefault(key, [])
                if not others or others[-1].stop <= mention.start:
                    others.append(mention)
    known = node_labels(Graph(spans, *[np.empty(0)] * 3), list(found))
    for mentions in met.values():
        if len(mentions) > 1:
            hub = next((m for m in mentions if known[m.start]), mentions[0])
            for one, other in zip(mentions, mentions[1:], strict=False):
                skip.update(links(one, other))
                skip.update(links(min(hub, other, key=lambda m: m.start), max(hub, other, key=lambda m: m.start)))
            if hub.start > mentions[0].start:
                skip.update(links(mentions[0], hub))
    pairs = lambda edges: np.array(edges, np.int64).reshape(-1, 2)
    return Graph(spans, np.array(rows, np.int64), pairs(chain), pairs(sorted(skip)))


def node_labels(g: Graph, found: list[Span]) -> np.ndarray:
    """The label of each node: the kind of the base span that overlaps it, the first in order of kinds."""
    labels = np.zeros(len(g.spans), np.int64)
    starts = np.array([s for s, _ in g.spans])
    ends = np.array([e for _, e in g.spans])
    for kind, start, end in sorted(found, key=lambda s: -RANK[s[0]]):
        labels[np.searchsorted(ends, start, "right") : np.searchsorted(starts, end, "left")] = 1 + RANK[kind]
    return labels


@dataclass
class Field:
    """Potentials: of features, of neighbours in the text, of similar tokens (symmetric)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def evidence(self, g: Graph, known: np.ndarray) -> np.ndarray:
        """Scores of the nodes' labels where those above 0 in ``known`` are given."""
        own = self.unary[g.features].sum(1)
        own[:, 1:] = np.minimum(own[:, 1:], own[:, :1])
        similar = np.unique(g.skip)
        own[similar, 1:] = np.maximum(own[similar, 1:], own[similar, :1] - DOUBT)
        given = np.flatnonzero(known)
        own[given] = -np.inf
        own[given, known[given]] = 0.0
        return own

    def beliefs(self, g: Graph, known: np.ndarray | None = None) -> np.ndarray:
        """Marginals of the nodes' labels by loopy sum-product message passing, with labels given as evidence if any."""
        own = self.unary[g.features].sum(1) if known is None else self.evidence(g, known)
        edges = np.concatenate([g.chain, g.skip])
        if len(edges):
            source = np.concatenate([edges[:, 0], edges[:, 1]])
            target = np.concatenate([edges[:, 1], edges[:, 0]])
            c, n = len(g.chain), len(edges)
            kinds = ((0, c, self.chain), (c, n, self.skip), (n, n + c, self.chain.T), (n + c, 2 * n, self.skip.T))
            back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
            messages = np.zeros((2 * n, own.shape[1]))
            for _ in range(ROUNDS):
                gathered = own.copy()
                np.add.at(gathered, target, messages)
                sent = gathered[source] - messages[back]
                new = np.empty_like(messages)
                for first, last, potential in kinds:
                    for at in range(first, last, BLOCK):
                        part = sent[at : min(last, at + BLOCK), :, None] + potential
                        top = part.max(1, keepdims=True)
                        new[at : at + len(part)] = np.log(np.exp(part - top).sum(1)) + top[:, 0]
                new = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
                change = np.abs(new - messages).max()
                messages = new
                if change < SETTLED:
                    break
            np.add.at(own, target, messages)
        own = np.exp(own - own.max(1, keepdims=True))
        return own / own.sum(1, keepdims=True)


def fit(samples: list[tuple[Graph, np.ndarray]]) -> Field | None:
    """Pseudo-likelihood: each node's label given its features and its neighbours' labels, and for nodes with similar ones given the latter alone."""
    if not samples:
        return None
    k = len(LABELS)
    offsets = np.cumsum([0, *(len(g.spans) for g, _ in samples)])
    features = np.concatenate([g.features for g, _ in samples])
    y = np.concatenate([labels for _, labels in samples])
    chain = np.concatenate([g.chain + o for (g, _), o in zip(samples, offsets, strict=False)])
    skip = np.concatenate([g.skip + o for (g, _), o in zip(samples, offsets, strict=False)])
    field = Field(np.zeros((WIDTH + 1, k)), np.zeros((k, k)), AGREE * np.eye(k))
    parts = [field.unary, field.chain, field.skip]
    priors = [np.zeros_like(field.unary), np.zeros_like(field.chain), AGREE * np.eye(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    similar = np.unique(skip)
    rows = np.concatenate([np.arange(len(y)), similar])
    features = np.concatenate([features, np.full((len(similar), features.shape[1]), HIDDEN)])
    for step in range(1, STEPS + 1):
        near = np.zeros((len(y), k))
        np.add.at(near, chain[:, 1], field.chain[y[chain[:, 0]]])
        np.add.at(near, chain[:, 0], field.chain.T[y[chain[:, 1]]])
        np.add.at(near, skip[:, 1], field.skip[y[skip[:, 0]]])
        np.add.at(near, skip[:, 0], field.skip[y[skip[:, 1]]])
        score = field.unary[features].sum(1) + near[rows]
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = p
        error[np.arange(len(rows)), y[rows]] -= 1
        error /= len(rows)
        by_unary, by_chain, by_skip = np.zeros_like(field.unary), np.zeros((k, k)), np.zeros((k, k))
        np.add.at(by_unary, features.ravel(), np.repeat(error, features.shape[1], 0))
        # hidden features tell of no kind more than of another
        by_unary[HIDDEN, 1:] = by_unary[HIDDEN, 1:].mean()
        np.add.at(error, similar, error[len(y) :])
        np.add.at(by_chain, y[chain[:, 0]], error[chain[:, 1]])
        np.add.at(by_chain.T, y[chain[:, 1]], error[chain[:, 0]])
        np.add.at(by_skip, y[skip[:, 0]], error[skip[:, 1]])
        np.add.at(by_skip, y[skip[:, 1]], error[skip[:, 0]])
        # one weight for labels that agree and one for others, so that similar tokens alone make no label likelier
        agree = np.trace(by_skip) / k
        by_skip = np.where(np.eye(k) > 0, agree, (by_skip.sum() - k * agree) / (k * k - k))
        for part, slope, prior, (first, second) in zip(parts, (by_unary, by_chain, by_skip), priors, moments, strict=True):
            slope = slope + 1e-5 * (part - prior)
            first *= 0.9
            first += 0.1 * slope
            second *= 0.999
            second += 0.001 * slope**2
            part -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return field


def added_spans(text: str, found: list[Span], field: Field | None) -> list[Span]:
    """Spans of tokens outside the base spans that the field is sure of; neighbours of one label make one span."""
    g = graph(text, found) if field is not None else None
    if g is None:
        return []
    known = node_labels(g, found)
    beliefs = field.beliefs(g, known)
    labels = np.where(beliefs[:, 1:].max(1) >= SURE, 1 + beliefs[:, 1:].argmax(1), 0)
    labels[known > 0] = 0
    side = {int(b) for _, b in g.chain}
    out: list[Span] = []
    for node in np.flatnonzero(labels):
        start, end = g.spans[node]
        token = text[start:end]
        start += len(token) - len(token.lstrip(_EDGE))
        end -= len(token) - len(token.rstrip(_EDGE))
        kind = KINDS[labels[node] - 1]
        if node in side and labels[node - 1] == labels[node] and out:
            out[-1] = (kind, out[-1][1], end)
        elif start < end:
            out.append((kind, start, end))
    return out


def recovery(samples: list[tuple[Graph, np.ndarray]], field: Field, most: int = 4) -> tuple[int, int, int]:
    """Held-out labels: of up to ``most`` known mentions a text whose label and features are hidden in turn, how many there are, and how many the field restores with and without its potentials between similar tokens."""
    hidden = restored = alone = 0
    plain = Field(field.unary, field.chain, np.zeros_like(field.skip))
    for g, labels in samples:
        for node in [n for n in np.unique(g.skip) if labels[n]][:most]:
            features, known = g.features.copy(), labels.copy()
            features[node], known[node] = HIDDEN, 0
            masked = Graph(g.spans, features, g.chain, g.skip)
            hidden += 1
            restored += field.beliefs(masked, known)[node, labels[node]] >= SURE
            alone += plain.beliefs(masked, known)[node, labels[node]] >= SURE
    return hidden, int(restored), int(alone)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field | None:
    """A field from about ``sample`` documents; of each, its graph's numbers and labels reach the driver, not its text."""
    usable = df.where(F.col(id_col).isNotNull() & F.col(text_col).rlike("[0-9@]"))
    n = usable.count()
    scale = 1 << 30
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("pii"), F.col(id_col)), F.lit(scale)) < int(min(1.0, sample / max(1, n)) * scale))

    def step(texts):
        made = [(graph(t, base_spans(t)), t) for t in texts]
        keep = [(g, t) if g is not None and len(g.spans) <= NODES else None for g, t in made]
        columns = [[None if k is None else getattr(k[0], name).astype("<i4").tobytes() for k in keep] for name in ("features", "chain", "skip")]
        return [*columns, [None if k is None else node_labels(k[0], base_spans(k[1])).astype("<i4").tobytes() for k in keep]]

    made = append_columns(drawn.select(F.col(text_col).alias("text")), ["text"], "features binary, chain binary, skip binary, labels binary", lambda: step).drop("text")
    samples = []
    for row in sorted(tuple(map(bytes, r)) for r in made.where("labels IS NOT NULL").collect()):
        features, chain, skip, labels = (np.frombuffer(x, "<i4").astype(np.int64) for x in row)
        samples.append((Graph([(0, 0)] * len(labels), features.reshape(len(labels), -1), chain.reshape(-1, 2), skip.reshape(-1, 2)), labels))
    return fit(samples)


def scan(df: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``df`` with base_spans and pii_spans: arrays of kind, start, end (code points, end exclusive)."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def make():
        def rows(spans):
            return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda s: (s[1], RANK[s[0]], s[2]))]

        def step(texts):
            base = [base_spans(t or "") for t in texts]
            every = [found + added_spans(t or "", found, shared.value) for t, found in zip(texts, base, strict=True)]
            return [[rows(x) for x in base], [rows(x) for x in every]]

        return step

    kind = "array<struct<kind:string,start:int,end:int>>"
    return append_columns(df, [text_col], f"base_spans {kind}, pii_spans {kind}", make)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: counts and digest of the base spans, and the text form of all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = scan(docs, train(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind) for kind in KINDS),
        F.sha2(text_of("base_spans").cast("binary"), 256).alias("base_sha256"),
        text_of("pii_spans").alias("spans"),
        (F.size("pii_spans") - F.size("base_spans")).cast("long").alias("n_added"),
    )
