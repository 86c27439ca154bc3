"""Toxic spans by a linear-chain conditional random field.

Training documents carry only a document label, so their tokens are labelled first: a token of a toxic document is
toxic if its word is far commoner in toxic than in clean documents. The field (two states, a weight for each word and its
neighbours, four transitions) is fitted by gradient ascent; forward-backward marginals tag every token of a text. A
logistic layer over the marginals gives the document's score; runs of tokens above one half are its offending offsets.

A text is read in chains of at most CHAIN tokens that overlap by LAP tokens at either end, so that every token that a chain answers for is
tagged with its neighbours. The field is fitted in a task of its own on a bounded sample; only the model comes to the driver.

Cases: null, empty and wordless texts get the layer's score for no evidence; very long texts are many chains; without labelled
rows of both kinds every score is the share of toxic labels (0 if none); repeated label rows of a document count once, by the
largest label; null labels are left out; different texts under one id are all labelled by it; rows that tie in the order of
the sample are equal in id and text, and one of them is drawn; other columns are ignored.
"""

from __future__ import annotations

import io
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import kept_as, lowest_by_hash, slices, small_batches, with_fields

WORD = re.compile(r"\w+")
CHAIN, LAP = 64, 8
STEP = CHAIN - 2 * LAP
SAMPLE_ROWS, SAMPLE_BYTES, VOCABULARY, MIN_DOCS, CHANCE = 3000, 20_000, 50_000, 5, 1e-4
BATCH, EPOCHS = 4096, 2  # chains of a gradient step; times that every chain is in one, at least


@dataclass
class ToxicField:
    vocabulary: dict[str, int]  # from 1; 0 is any other word
    own: np.ndarray
    left: np.ndarray  # weight of the word before
    right: np.ndarray  # weight of the word after
    bias: float
    move: np.ndarray  # 2 x 2 log potentials of transitions
    layer: np.ndarray  # document layer: constant, log-odds of the largest marginal, log of the expected toxic tokens

    def emissions(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        e = self.own[ids] + self.bias
        e[:, 1:] += self.left[ids[:, :-1]]
        e[:, :-1] += np.where(mask[:, 1:], self.right[ids[:, 1:]], 0.0)
        return e


def marginals(emission: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token and P(state i, then state j) of each neighbouring pair, by forward-backward over all
    chains (rows) at once. Masked tokens are at the row's end."""
    n, t = emission.shape
    m, e = np.exp(move), np.exp(np.clip(emission, -30, 30))
    forward, back = np.empty((t, n, 2)), np.ones((t, n, 2))
    a = np.stack([np.ones(n), e[:, 0]], 1)
    forward[0] = a / a.sum(1, keepdims=True)
    for k in range(1, t):
        a = forward[k - 1] @ m
        a[:, 1] *= e[:, k]
        forward[k] = a / a.sum(1, keepdims=True)
    for k in range(t - 2, -1, -1):
        b = back[k + 1].copy()
        b[:, 1] *= e[:, k + 1]
        b = b @ m.T
        b /= b.sum(1, keepdims=True)
        back[k] = np.where(mask[:, k + 1, None], b, 1.0)
    p = forward * back
    p = (p[:, :, 1] / p.sum(2)).T
    pair = forward[:-1, :, :, None] * m * (back[1:] * np.stack([np.ones((t - 1, n)), e[:, 1:].T], 2))[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p, pair * mask[:, 1:].T[:, :, None, None]


def _chains(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of several texts as padded rows, their mask, the text of each row, the tokens that each row answers for, and where
    they stand in the texts laid end to end."""
    sizes = np.array([len(x) for x in tokens], np.int64)
    rows = -(-sizes // STEP)
    of = np.repeat(np.arange(len(tokens)), rows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
    nth = nth.astype(np.int32)
    at = np.maximum(0, nth * STEP - LAP)[:, None] + np.arange(CHAIN, dtype=np.int32)
    mask = at < np.minimum(sizes[of], nth * STEP + STEP + LAP)[:, None]
    own = mask & (at >= nth[:, None] * STEP) & (at < (nth[:, None] + 1) * STEP)
    flat = np.concatenate([*tokens, np.zeros(1, np.int32)])
    place = (np.cumsum(sizes) - sizes).astype(np.int32)[of][:, None] + at
    ids = np.where(mask, flat[np.minimum(place, len(flat) - 1)], 0)
    return ids, mask, of, own, place[own]


def _evidence(field: ToxicField, tokens: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Inputs of the document layer, and the marginals of each text's tokens."""
    ids, mask, of, own, place = _chains(tokens)
    top, total = np.zeros(len(tokens)), np.zeros(len(tokens))
    flat = np.zeros(sum(map(len, tokens)))
    if len(ids):
        p = np.concatenate([_only_p(field, ids[i : i + BATCH], mask[i : i + BATCH]) for i in range(0, len(ids), BATCH)])
        p = np.where(own, p, 0.0)
        np.maximum.at(top, of, p.max(1))
        np.add.at(total, of, p.sum(1))
        flat[place] = p[own]
    top = np.clip(top, 1e-4, 1 - 1e-4)
    per_text = np.split(flat, np.cumsum([len(x) for x in tokens])[:-1]) if tokens else []
    return np.stack([np.ones(len(tokens)), np.log(top / (1 - top)), np.log1p(total)], 1), per_text


def _only_p(field: ToxicField, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Marginals without the pairs: both passes on ratios of the two states."""
    e = np.exp(np.clip(field.emissions(ids, mask), -30, 30))
    m = np.exp(field.move)
    ratio, back = np.empty(ids.shape), np.ones(ids.shape)
    r = e[:, 0].copy()
    ratio[:, 0] = r
    for k in range(1, ids.shape[1]):
        r = e[:, k] * (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r)
        ratio[:, k] = r
    b = np.ones(len(ids))
    for k in range(ids.shape[1] - 2, -1, -1):
        x = e[:, k + 1] * b
        b = np.where(mask[:, k + 1], (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x), 1.0)
        back[:, k] = b
    odds = ratio * back
    return odds / (1 + odds)


def by_chance(toxic: int, clean: int, share: float) -> float:
    """Probability that so many or more of a word's documents are toxic if each is with probability `share`."""
    n = toxic + clean
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(toxic, n + 1)]
    return sum(map(math.exp, logs))


def fit(texts: list[str], labels: list[int], weights: list[float], steps: int = 80, vocabulary_words: int = VOCABULARY) -> ToxicField:
    """Field and document layer from a bounded list of labelled texts; `weights` undo how the sample was drawn. The field knows the
    `vocabulary_words` commonest words; others share one weight."""
    number: dict[str, int] = {}
    words = [np.fromiter((number.setdefault(w, len(number)) for w in WORD.findall(t.lower())), np.int32) for t in texts]
    names = list(number)
    toxic, clean = Counter(), Counter()
    for w, y in zip(words, labels):
        (toxic if y else clean).update(np.unique(w).tolist())
    n1, n0 = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    # A word counts as toxic if its share of toxic documents is many times its share of clean ones, by more than chance, in
    # settings that differ: copies of one toxic document don't make its other words toxic. The share itself is free, so that
    # the words of a language with few documents count too.
    likely = {w for w, n in toxic.items() if n >= MIN_DOCS and n / n1 > 8 * (clean[w] + 1) / n0 and by_chance(n, clean[w], n1 / (n1 + n0)) < CHANCE}
    around: dict[int, set] = {w: set() for w in likely}
    some = np.zeros(len(names) + 1, bool)
    some[list(likely)] = True
    for w, y in zip(words, labels):
        if y:
            padded = np.r_[-1, w, -1]
            for k in np.flatnonzero(some[w]).tolist():
                around[int(w[k])].add((int(padded[k]), int(padded[k + 2])))
    odd = {w for w in likely if len(around[w]) > max(MIN_DOCS, toxic[w] / 2)}
    both = toxic + clean
    common = sorted((-n, names[w], w) for w, n in both.items() if n >= MIN_DOCS or w in odd)[:vocabulary_words]
    vocabulary = {w: i for i, w in enumerate(sorted(name for _, name, _ in common), 1)}
    index = np.zeros(len(names) + 1, np.int32)
    for _, name, w in common:
        index[w] = vocabulary[name]
    tokens = [index[w] for w in words]
    ids, mask, of, _, _ = _chains(tokens)
    is_odd = np.zeros(len(vocabulary) + 1, bool)
    is_odd[[index[w] for w in odd]] = True
    is_odd[0] = False
    y = is_odd[ids] & mask & np.array(labels, bool)[of][:, None]
    # Every chain is learned from, in batches that hold both sorts alike: toxic chains and others, each in an order drawn at random.
    some, rest = np.flatnonzero(y.any(1)), np.flatnonzero(~y.any(1))
    draw = np.random.default_rng(0)
    pick = np.r_[draw.permutation(some), draw.permutation(rest)]
    pick = pick[np.argsort(np.r_[(np.arange(len(some)) + 0.5) / max(1, len(some)), (np.arange(len(rest)) + 0.5) / max(1, len(rest))], kind="stable")]
    batches = np.array_split(pick, max(1, -(-len(pick) // BATCH)))
    steps = max(steps, EPOCHS * len(batches))
    field = ToxicField(vocabulary, *(np.zeros(len(vocabulary) + 1) for _ in range(3)), -3.0, np.zeros((2, 2)), np.zeros(3))
    parts = [field.own, field.left, field.right, np.array([field.bias]), field.move]
    mean, var = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    size = len(vocabulary) + 1
    for step in range(1, steps + 1 if len(some) else 1):
        at = batches[step % len(batches)]
        ids_, mask_, y_ = ids[at], mask[at], y[at]
        field.bias = float(parts[3][0])
        p, pair = marginals(field.emissions(ids_, mask_), mask_, field.move)
        d = np.where(mask_, y_ - p, 0.0)
        # How often a state follows a state by the labels, over neighbours in the chain.
        pair_y = np.bincount((2 * y_[:, :-1] + y_[:, 1:])[mask_[:, 1:]], minlength=4).reshape(2, 2)
        grads = [np.bincount(ids_.ravel(), d.ravel(), size), np.bincount(ids_[:, :-1].ravel(), d[:, 1:].ravel(), size), np.bincount(np.where(mask_[:, 1:], ids_[:, 1:], 0).ravel(), (d[:, :-1] * mask_[:, 1:]).ravel(), size), np.array([d.sum()]), pair_y - pair.sum((0, 1))]
        for k, (x, g) in enumerate(zip(parts, grads)):
            g = g * (len(pick) / len(at)) - 0.05 * x  # Gaussian prior
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            x += 0.15 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    field.bias = float(parts[3][0])
    z = np.concatenate([_evidence(field, tokens[i : i + 256])[0] for i in range(0, len(tokens), 256)])
    t, w = np.array(labels, np.float64), np.array(weights)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ field.layer, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3)
        field.layer = field.layer + np.linalg.solve(h, z.T @ (w * (t - p)) - 0.1 * field.layer)
    return field


def packed(model: ToxicField | float) -> bytes:
    if isinstance(model, float):
        return np.float64(model).tobytes()
    out = io.BytesIO()
    words = np.frombuffer("\n".join(model.vocabulary).encode(), np.uint8)
    np.savez_compressed(out, words=words, own=model.own, left=model.left, right=model.right, bias=np.float64(model.bias), move=model.move, layer=model.layer)
    return out.getvalue()


def unpacked(raw: bytes) -> ToxicField | float:
    if len(raw) == 8:
        return float(np.frombuffer(raw, np.float64)[0])
    with np.load(io.BytesIO(raw)) as x:
        words = x["words"].tobytes().decode()
        vocabulary = {w: i for i, w in enumerate(words.split("\n") if words else [], 1)}
        return ToxicField(vocabulary, x["own"], x["left"], x["right"], float(x["bias"]), x["move"], x["layer"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows=None, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, vocabulary_words: int = VOCABULARY) -> ToxicField | float:
    """Learns from `sample_rows` labelled texts of each kind at most, of at most `sample_bytes` bytes, drawn by hash: among
    2 * `sample_rows` labelled ids of each kind, for some have no such text.

    `train_rows` is a condition on the id column that labels have to meet. With one kind only, the share of label 1.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if train_rows is not None:
        marked = marked.where(train_rows)
    marked = marked.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return float(bool(totals.get(1)))
    kinds = [lowest_by_hash(marked.where(F.col("toxic") == kind), ["doc_id"], 2 * sample_rows) for kind in (0, 1)]
    texts = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= sample_bytes)).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(kinds[0].unionAll(kinds[1])), "doc_id")  # at most 4 * sample_rows ids
    found = found.withColumn("digest", F.md5("text")).groupBy("toxic", "doc_id", "digest").agg(F.first("text").alias("text"))
    order = [F.xxhash64("doc_id"), "doc_id", "digest"]
    sample = [found.where(F.col("toxic") == kind).orderBy(*order).limit(sample_rows) for kind in (0, 1)]
    whole = totals[0] + totals[1]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[int, str]] = [x for b in batches for x in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist())]
        known.sort()
        n1 = sum(y for y, _ in known)
        n = (len(known) - n1, n1)
        if not n[0] or not n[1]:
            model: ToxicField | float = float(bool(n1))
        else:
            share = [totals[k] / whole / n[k] * len(known) for k in (0, 1)]
            model = fit([t for _, t in known], [y for y, _ in known], [share[y] for y, _ in known], vocabulary_words=vocabulary_words)
        yield pa.RecordBatch.from_arrays([pa.array([packed(model)], pa.binary())], names=["model"])

    one = sample[0].unionAll(sample[1]).select("toxic", "text").repartition(1)
    made = one.mapInArrow(learn, "model binary").collect()  # a row, of vocabulary_words words at most
    return unpacked(made[0]["model"]) if made else 0.0


def score(docs: DataFrame, model: ToxicField | float, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with `score` and `spans`, an array of (start, stop, weight) in code points of the text as it is.

    A kept column named like one of these comes as `doc_<name>`.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches, 1 << 20, "_text"):
            texts = batch.column("_text").to_pylist()
            spans: list[list[dict]] = [[] for _ in texts]
            if isinstance(field, float):
                out = np.full(len(texts), field)
            else:
                known = field.vocabulary.get
                tokens = [np.array([known(x, 0) for x in WORD.findall((t or "").lower())], np.int32) for t in texts]
                z, per_text = _evidence(field, tokens)
                out = 1 / (1 + np.exp(-np.clip(z @ field.layer, -30, 30)))
                for i, p in enumerate(per_text):
                    if len(p) and p.max() > 0.5:
                        spans[i] = _runs(texts[i], p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64()), pa.array(spans, kind)], names=[*batch.schema.names[:-1], "score", "spans"])

    rows = docs.select(*kept_as(keep, ("score", "spans", "_text")), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, with_fields(rows.drop("_text").schema, "score double, spans array<struct<start:int,stop:int,weight:double>>"))


def _runs(text: str, p: np.ndarray) -> list[dict]:
    """Neighbouring toxic tokens as one span each. Tokens are those of the lower-cased text, in which a character may have become several:
    their places are led back to the characters that they come from."""
    low = text.lower()
    at = range(len(text) + 1) if len(low) == len(text) else np.repeat(np.arange(len(text) + 1), [*(len(c.lower()) for c in text), 1])
    out: list[dict] = []
    for k, m in enumerate(WORD.finditer(low)):
        if k < len(p) and p[k] > 0.5:
            start, stop = int(at[m.start()]), int(at[m.end() - 1]) + 1
            if out and out[-1]["last"] == k - 1:
                out[-1] |= {"stop": stop, "last": k, "weight": max(out[-1]["weight"], float(p[k]))}
            else:
                out.append({"start": start, "stop": stop, "last": k, "weight": float(p[k])})
    return [{k: x[k] for k in ("start", "stop", "weight")} for x in out]


def accept(scores: DataFrame) -> DataFrame:
    return scores.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))

