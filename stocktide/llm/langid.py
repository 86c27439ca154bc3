"""Language identification by multinomial naive Bayes over hashed character n-grams.

`train` counts the hashed 1- to `MAX_N`-grams of every labelled text per language; the matrix of log-probabilities
has `BUCKETS` rows and a column per language, so its size doesn't depend on the data and it is broadcast.
`predict` scores batches of texts in numpy.

Cases: null texts and texts without a letter are `und` with score 0; rows with null language aren't learned from;
without any labelled row every text is `und`; ties go to the language first in code-point order; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import kept_as, slices, with_fields

BUCKETS = 1 << 15
MAX_N = 3
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # language x bucket
    log_prior: np.ndarray


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams, an array for each n over the texts laid end to end, each text framed by spaces; where texts start."""
    framed = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *map(len, framed)])
    h = points * np.uint32(0x9E3779B1)
    grams = [h >> np.uint32(17)]
    for n in range(2, MAX_N + 1):
        h = h[:-1] * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
        mixed = h ^ (h >> np.uint32(15))
        mixed *= np.uint32(0x2C1B3C6D)
        grams.append(mixed >> np.uint32(17))
    return grams, starts


def _inside(grams: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Marks n-grams that don't run over the end of their text."""
    keep = np.ones(len(grams), bool)
    for back in range(1, n):
        at = starts[1:] - back
        keep[at[at < len(grams)]] = False
    return keep


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts come from all rows; what reaches the driver is at most languages x BUCKETS counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1 << 20):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                grams, starts = _grams(texts)
                total = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for n, g in enumerate(grams, 1):
                    total[:-1] += np.bincount(g[_inside(g, starts, n)], minlength=BUCKETS)
                total[-1] += len(texts)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    matrix = np.zeros((len(languages), BUCKETS + 1))
    matrix[[languages.index(x) for x in counts["lang"]], counts["bucket"]] = counts["n"]
    grams, texts = matrix[:, :-1] + 0.5, matrix[:, -1]
    return LanguageModel(languages, np.log(grams / grams.sum(1, keepdims=True)), np.log((texts + 1) / (texts + 1).sum()) if languages else texts)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score (posterior of the predicted language) for every row, beside its id and the `keep` columns; one named like
    an output comes as `doc_<name>`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = shared.value
        for batch in slices(batches, 1 << 20):
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if m.languages and t and any(map(str.isalpha, t))]
            lang, conf = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                grams, starts = _grams([texts[i] for i in known])
                logs = np.repeat(m.log_prior[:, None], len(known), 1)
                for n, g in enumerate(grams, 1):
                    inside = _inside(g, starts, n)
                    for k in range(len(m.languages)):
                        logs[k] += np.add.reduceat(np.where(inside, m.log_prob[k][g], 0.0), starts[:-1])
                best = logs.argmax(0)
                p = 1 / np.exp(logs - logs.max(0)).sum(0)
                for j, i in enumerate(known):
                    lang[i], conf[i] = m.languages[best[j]], p[j]
            rest = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(conf, pa.float64())], names=[*(x for x in batch.schema.names if x != "text"), "lang_pred", "score"])

    rows = docs.select(*kept_as((id_col, *keep), ("lang_pred", "score", "text")), F.col(text_col).cast("string").alias("text"))
    schema = with_fields(rows.drop("text").schema, "lang_pred string, score double")
    return rows.mapInArrow(score, schema)
