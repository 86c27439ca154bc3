"""Best-fit packing whose bin counts are certified by dual-feasible-function lower bounds.

`token_pieces` tokenises whole texts and cuts only documents longer than a sequence. `pack` deals the
pieces to partitions of bounded size, packs each best-fit decreasing and bounds its bin count from
below with dual feasible functions. A partition whose count equals its bound is final. Partitions with a
gap exchange the pieces of their unfilled bins with a neighbour and run best-fit decreasing again;
the better of the old and the new packing stays.

Cases: a null text counts as empty (one end id); a very long text is as many full pieces as it takes, read whole; pieces that tie
in length go in order of id, piece and content; an empty table gives no rows; repeated rows and rows without an id are packed each on
its own; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import small_batches, stored

END_ID = 2
WORD_CACHE = 1 << 17
LONG_SPACE = 4096
GROUP_ITEMS = 1 << 16
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", g bigint, bin bigint, offset bigint, free int, gap bigint"


class _Encoder(dict):
    """Word -> little-endian ids of " word", filled as words turn up.

    The ids are those of `tokenizers` with the vocabulary's json, without special tokens added. Its merges in the core of
    `tiktoken` give the same ids faster, but that core knows no added tokens and fails on very long runs of white space: texts with
    either go through `tokenizers` itself.

    A single space between two characters that aren't white space always starts a new pre-token, so such a text
    can be encoded word by word; any other text is encoded in one piece.
    """

    def __init__(self, vocabulary: str, added: list[str]):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        core = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.whole, self.single = core.encode_ordinary, core.encode_single_piece
        self.spaces = re.compile(r"\s\s+")
        self.json, self.exact, self.added = public_tokenizers.path(vocabulary), None, added

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.single((" " + word).encode()) if word.isalpha() else self.whole(" " + word)).tobytes()
        self[word] = ids
        return ids

    def by_tokenizers(self, text: str) -> bytes:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json)
        return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return self.by_tokenizers(text)
        if self.spaces.search(text):
            if any(x.end() - x.start() > LONG_SPACE for x in self.spaces.finditer(text)):
                return self.by_tokenizers(text)
            return array("I", self.whole(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.whole(first)).tobytes() + b"".join(map(self.__getitem__, rest))


def added_tokens(vocabulary: str) -> list[str]:
    """The few tokens that the vocabulary has beside its merges. Read once, for the whole of its json takes much memory."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


def token_pieces(docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. The ids of a document (its tokens, then the end id) are cut only when there are more
    than `capacity`; then all pieces but the first are full."""

    small_batches(docs.sparkSession)
    added = added_tokens(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(vocabulary, added)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                bounds = [0, *range(first, n + 1, capacity)]
                if len(encoder) > WORD_CACHE:
                    encoder.clear()
                for k in range(len(bounds) - 1):
                    a, b = bounds[k], bounds[k + 1]
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Best of the bounds that two families of dual feasible functions give for these lengths."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for alpha in range(1, capacity // 2 + 1):  # small items count nothing, their complements count as whole bins
        f = np.where(x > capacity - alpha, capacity, np.where(x < alpha, 0, x))
        best = max(best, -(-int((counts * f).sum()) // capacity))
    for k in range(1, 33):  # round to multiples of a k-th, exact multiples of a (k+1)-th stay
        scaled = (k + 1) * x
        f = np.where(scaled % capacity == 0, k * x, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * f).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; items go, longest first, to the fullest bin that still takes them."""
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_mask, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = free_mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                free_mask ^= 1 << free
        else:
            free, b, used = capacity, used, used + 1
        bins[i] = b
        rest = free - size
        if rest:
            if not open_bins[rest]:
                free_mask |= 1 << rest
            open_bins[rest].append(b)
    return bins


def _laid_out(pdf: pd.DataFrame, bins: np.ndarray, capacity: int, gap: int) -> pd.DataFrame:
    order = np.argsort(bins, kind="stable")
    pdf, bins = pdf.iloc[order].reset_index(drop=True), bins[order]
    lengths = pdf["length"].to_numpy()
    total = np.cumsum(lengths)
    starts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(bins) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(bins)])
    base = np.repeat(total[starts] - lengths[starts], sizes)
    filled = np.repeat(np.add.reduceat(lengths, starts) if len(starts) else lengths, sizes)
    return pdf.assign(bin=bins, offset=total - lengths - base, free=(capacity - filled).astype(np.int32), gap=gap)


def pack(pieces: DataFrame, capacity: int = 1024, group_items: int = GROUP_ITEMS, rounds: int = 3) -> DataFrame:
    """Sequence and offset of each piece. A group holds about `group_items` pieces, at most 2**rounds times as many
    after the exchanges; groups that no exchange improves keep their packing."""
    names = PIECES.replace(" bigint", "").replace(" int", "").split(", ")
    groups = max(1, math.ceil(pieces.count() / group_items))

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ignore_index=True)
        bins = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        gap = int(bins.max()) + 1 - lower_bound(pdf["length"].to_numpy(), capacity)
        return _laid_out(pdf, bins, capacity, gap)

    def exchange(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "bin", "offset"], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        old = pd.factorize(pd.MultiIndex.from_frame(pdf[["g", "bin"]]))[0].astype(np.int64)
        new = best_fit_decreasing(lengths, capacity)
        bins = new if new.max() < old.max() else old
        gap = int(bins.max()) + 1 - lower_bound(lengths, capacity)
        return _laid_out(pdf.assign(g=int(key[0])), bins, capacity, gap)

    # Pieces are read from a table: the row number is the same whenever a task is run again, and deals rows of one id apart.
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    state = stored(dealt.groupBy("g").applyInPandas(first, PACKED), "packed")
    done = []
    for r in range(rounds + 1):
        again = (F.col("gap") > 0) & (F.col("free") > 0) if r < rounds and groups >> r > 1 else F.lit(False)
        done.append(state.where(~again).select(*names, ((F.lit(r) * groups + F.col("g")) * (1 << 26) + F.col("bin")).alias("sequence_id"), "offset"))
        if not (r < rounds and groups >> r > 1) or state.where(again).isEmpty():
            break
        state = stored(state.where(again).withColumn("g", F.expr("g div 2")).groupBy("g").applyInPandas(exchange, PACKED), "packed")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def packed_documents(docs: DataFrame, capacity: int = 1024, **names) -> DataFrame:
    return pack(stored(token_pieces(docs, capacity, **names), "pieces"), capacity)
