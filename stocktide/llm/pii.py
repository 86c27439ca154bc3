"""Personal data by candidate gradient boosting.

Generators propose spans: the four base patterns with their checks, and looser ones, which may overlap. Base spans that pass their
check always stay. Boosted trees score the looser candidates by format and context; a threshold calibrated on held-out candidates selects
which are added. Added spans never overlap a base span or each other.

Nobody labels loose candidates, so training makes some: base spans that pass are written anew where they stand, as people write them
to hide or to group them ("ann (at) example (dot) org", "0049.30.123456"), and what the generators propose there counts as
personal data if it is that span, and not if it is only a part of it. What they propose elsewhere, and base matches that fail their check, count
as other numbers. The checks themselves aren't features.

Cases: a null or empty text has no spans; very long texts are scanned whole; without enough training candidates nothing is added; offsets are
code points; ties in overlap go to the higher score, then the earlier and longer span; repeated texts are learned from once;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import kept_as, lowest_by_hash, slices, small_batches, with_fields

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match of this pattern starts at the first digit of a run in any case; saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser generators, by the kind that a chosen span gets.
LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{0,2}[0-9]{4}){2,3}[0-9]{0,3}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[ ./-]{1,2}[(]?[0-9]{2,4}[)]?){1,5}(?![0-9])")),
)
DIGIT, HINT, LOOSE_MAIL = re.compile("[0-9]"), re.compile(r"[0-9@]"), re.compile(r"\(at\)|\[at\]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
SPANS = "array<struct<start:int,stop:int,kind:string>>"
SAMPLE_ROWS, SAMPLE_BYTES, PRECISION = 4000, 20_000, 0.99


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, passes its check) of leftmost non-overlapping base matches of each kind."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = HOST.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), "email", True))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), "ip", all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))) for m in IP.finditer(text)]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            found.append((m.start(), m.end(), "card", 14 <= len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            found += [(m.start(), m.end(), "phone", 10 <= sum(c in "0123456789" for c in m[0]) <= 15) for m in PHONE.finditer(text)]
    return found


def loose_candidates(text: str, base: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """Spans of the looser generators that are no base span and overlap none that passed."""
    out = []
    held = sorted((a, b) for a, b, _, ok in base if ok)
    for kind, pattern in LOOSE:
        if kind == "email" and not LOOSE_MAIL.search(text) or kind != "email" and not DIGIT.search(text):
            continue
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if held:
        starts, ends = np.array(held).T
        ends = np.maximum.accumulate(ends)
        out = [x for x in out if (k := int(np.searchsorted(starts, x[1]))) == 0 or ends[k - 1] <= x[0]]
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span, then its context; the sign that only base phones have isn't among them."""
    span = text[start:end]
    digits = [c for c in span if "0" <= c <= "9"]
    groups = re.findall("[0-9]+", span)
    left, right = text[max(0, start - 24) : start], text[end : end + 12]
    n = len(span)
    counts = [span.count(c) for c in " -.()@"]
    entropy = -sum(k / n * math.log2(k / n) for k in (span.count(c) for c in set(span)))
    edge = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    return [
        KINDS.index(kind), n, len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[-1]) if groups else 0, *counts, entropy,
        max((int(g[:6]) for g in groups), default=-1), float(any(len(g) > 1 and g[0] == "0" for g in groups)),
        edge(left[-1:]), edge(right[:1]), float(bool(re.search(r"[=:#] ?\"?$", left))), sum(c.isdigit() for c in left), sum(c.isdigit() for c in right), sum(c.isalpha() for c in left),
    ]


@dataclass
class BoostedTrees:
    """Logistic boosting of depth-`depth` trees over quantile bins; each tree is an array of splits and one of leaf values."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        out = np.full(len(x), self.base)
        for feature, split, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > split[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32) -> BoostedTrees:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = BoostedTrees(edges, [], math.log(mean / (1 - mean)))
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        inner = 2**depth - 1
        feature, split, node = np.zeros(inner, np.int64), np.full(inner, bins + 1), np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) < 8:
                    continue
                best = 1e-6
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for j in range(x.shape[1]):
                    gs = np.cumsum(np.bincount(binned[rows, j], g[rows], bins + 1))
                    hs = np.cumsum(np.bincount(binned[rows, j], h[rows], bins + 1))
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
                    if gain.max() > best:
                        best, feature[k], split[k] = gain.max(), j, int(gain.argmax())
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + 1)
        model.trees.append((feature, split, leaf))
        score += leaf[at]
    return model


def calibrate(model: BoostedTrees, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> BoostedTrees:
    """Platt scaling on held-out candidates, then the lowest threshold that reaches the precision there."""
    raw = model.raw(x)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        a, b = a + 0.1 * ((y - p) * raw).mean() / (raw.std() + 1), b + 0.1 * (y - p).mean()
    model.slope, model.shift = a, b
    p = model.probability(x)
    order = np.argsort(-p)
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    model.threshold = float(max(0.9, p[order[good[-1]]])) if len(good) else 1.1
    return model


def rewritten(span: str, kind: str, form: int) -> str:
    """A base span as people write it to hide or to group it; `form` picks the way."""
    if kind == "email":
        local, host = span.rsplit("@", 1)
        at, dot = ((" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "."), ("[at]", " [dot] "))[form % 4]
        return local + at + host.replace(".", dot)
    if kind == "ip":
        return span.replace(".", (" . ", ". ", " .")[form % 3])
    digits = re.sub("[^0-9]", "", span)
    if kind == "card":
        return (".", "_", "/", " - ", "  ")[form % 5].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    lead = ("00", "+", "")[form % 3]
    sep = (".", "/", " ", "-")[form // 3 % 4]
    return lead + sep.join([digits[:2], *(digits[k : k + 3] for k in range(2, len(digits) - 3, 3)), digits[2 + (len(digits) - 5 + 2) // 3 * 3 :] or digits[-2:]])


def labelled_candidates(text: str) -> tuple[list[list[float]], list[float]]:
    """Features and labels of the candidates that one text gives for training."""
    base = base_candidates(text)
    x = [features(text, *c[:3]) for c in base if not c[3]]
    x += [features(text, *c) for c in loose_candidates(text, base)]
    y = [0.0] * len(x)
    for start, end, kind, ok in base:
        if not ok:
            continue
        new = rewritten(text[start:end], kind, zlib.crc32(text[start:end].encode()))
        # Context enough for the features; a window keeps long texts linear.
        left, right = text[max(0, start - 64) : start], text[end : end + 64]
        around, at = left + new + right, len(left)
        for a, b, k in loose_candidates(around, [c for c in base_candidates(around) if c[0] >= at + len(new) or c[1] <= at]):
            if a < at + len(new) and b > at:
                x.append(features(around, a, b, k))
                y.append(float(k == kind and a <= at and b >= at + len(new) and b - a <= len(new) + 2))
    return x, y


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> BoostedTrees | None:
    """Learns from the candidates of at most `sample_rows` distinct texts of at most `sample_bytes` bytes each, chosen by hash, in a task
    of its own; only the model comes to the driver."""
    rows = docs.where((F.octet_length(text_col) <= sample_bytes) & F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).cast("string").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted(t for b in batches for t in b.column("text").to_pylist())
        x, y, fold = [], [], []
        for text in texts:
            xs, ys = labelled_candidates(text)
            x += xs
            y += ys
            fold += [hashlib.sha256(text.encode()).digest()[0] % 4 == 0] * len(xs)
        y_, held = np.array(y), np.array(fold, bool)
        model = None
        if len(y) >= 50 and held.sum() >= 10 and 0 < y_[~held].mean() < 1:
            x_ = np.array(x, np.float64)
            model = calibrate(fit_trees(x_[~held], y_[~held]), x_[held], y_[held])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = lowest_by_hash(rows, ["text"], sample_rows).repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def find_spans(text: str, model: BoostedTrees | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans of one text."""
    if not text or not (HINT.search(text) or LOOSE_MAIL.search(text)):
        return [], []
    base = base_candidates(text)
    added: list[tuple[int, int, str]] = []
    loose = loose_candidates(text, base) if model else []
    if loose:
        p = model.probability(np.array([features(text, *c) for c in loose], np.float64))
        for _, start, end, kind in sorted((-p[i], a, -b, k) for i, (a, b, k) in enumerate(loose) if p[i] >= model.threshold):
            k = bisect_right(added, (start,))
            if (k == 0 or added[k - 1][1] <= start) and (k == len(added) or -end <= added[k][0]):
                added.insert(k, (start, -end, kind))
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted((x[:3] for x in base if x[3]), key=order), sorted(added, key=order)


def detect(docs: DataFrame, model: BoostedTrees | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """The `keep` columns with arrays `base` and `added` of spans, or with the redacted text when `redact` is set. A kept column named like
    one of these comes as `doc_<name>`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
    outputs = ("redacted", "_text") if redact else ("base", "added", "_text")
    rows = docs.select(*kept_as(keep, outputs), F.col(text_col).cast("string").alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="_text"):
            texts = batch.column("_text").to_pylist()
            spans = [find_spans(t, shared.value) for t in texts]
            if redact:
                new = [pa.array([redacted(t, b + a) for t, (b, a) in zip(texts, spans)], pa.string())]
            else:
                new = [pa.array([[dict(zip(("start", "stop", "kind"), x)) for x in s[k]] for s in spans], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *(["redacted"] if redact else ["base", "added"])])

    schema = rows.drop("_text").schema
    if redact:
        return rows.mapInArrow(scan, with_fields(schema, "redacted string"))
    return rows.mapInArrow(scan, with_fields(schema, f"base {SPANS}, added {SPANS}"))


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Each span replaced by its kind in brackets; overlapping spans become one, under the kind of the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
