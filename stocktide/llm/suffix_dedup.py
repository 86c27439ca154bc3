"""Exact substring dedup by a column-wise multi-document Burrows-Wheeler construction.

A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller id.

The texts are cut into fragments so that the construction can be spread: each run of windows (strings of `length` bytes) with
the same minimizer is a fragment, and windows that are equal have equal minimizers, so all their copies meet in one
bucket. A first pass keeps only minimizers found in two or more texts. Each bucket's fragments are a collection whose
Burrows-Wheeler transform grows by columns: each round inserts one symbol of every fragment, from the ends to the starts,
and rewrites the records of the transform (suffix, symbol, common prefix with the neighbour) from front to back, block by block. Records
lie in scratch files of the task once they outgrow memory, so that a round holds a few blocks. Neighbours that share
`length` bytes are equal windows.

Minimizers of more than `hot` fragments (those that differ within a chunk of texts, summed over the chunks) would overfill a
bucket. Their windows are fragments of their own, dealt to sub-buckets by content, and go through the same construction.

Cases: a null text is empty; texts shorter than `length` lose nothing; very long texts are read in slices; equal ids never
remove each other's bytes, null ids count as smallest; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import stored, text_bytes

LENGTH, MINIMIZER = 50, 24
CHUNK_BYTES = 8 << 20
SHARE_BYTES = 32 << 20  # of text for each share of the minimizers
BUCKET_BYTES = 1 << 20  # of text for each bucket
SLICE = 1 << 17
IN_MEMORY = 64 << 20  # bytes of a column; longer ones lie in files
BLOCK = 1 << 20  # entries of a column that a round looks at together
HOT = 1 << 16  # fragments of one minimizer, of at most 76 bytes each
LOWEST = -(1 << 63)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * C2
    return (x ^ (x >> np.uint64(29))) * C3


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every n bytes in a row, 8 at least: words of eight bytes, the last two of which may overlap."""
    words = np.empty(len(data) - 7, np.uint64)
    for k in range(min(8, len(words))):
        words[k::8] = np.frombuffer(data, "<u8", (len(data) - k) // 8, k)
    many = len(data) - n + 1
    with np.errstate(over="ignore"):
        h, factor = words[:many] * C1, C1
        for at in [*range(8, n - 8, 8), *([n - 8] if n > 8 else [])]:
            factor = factor * C3 | np.uint64(1)
            h += words[at : at + many] * factor
        return _mix(h)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def minimizer_runs(texts: list[bytes], length: int = LENGTH, m: int = MINIMIZER) -> tuple[np.ndarray, ...]:
    """(text, hash, first window, windows, hash of the fragment) of the runs of windows that share a minimizer (the leftmost of
    the least hashes), in order. The texts are read end to end; windows over an end are left out.

    A position is told apart by its hash and, as the window slides on, by whether the least hash is met anew.
    """
    names = (np.int64, np.uint64, np.int64, np.int64, np.uint64)
    out: list[tuple] = []
    data = np.frombuffer(b"".join(texts), np.uint8)
    stops = np.cumsum([0, *map(len, texts)])
    w = length - m + 1
    for start in range(0, len(data) - length + 1, SLICE):
        part = data[start : min(len(data), start + SLICE + length - 1)]
        all_h = _hashes(part, m)
        least = _sliding_min(all_h, w)
        new = np.empty(len(least), bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        inside = stops[np.searchsorted(stops, start) : np.searchsorted(stops, start + len(least))]
        new[inside - start] = True
        first = np.flatnonzero(new)
        h, n = least[first], np.diff(np.r_[first, len(least)])
        text = np.searchsorted(stops, start + first, "right") - 1
        n = np.minimum(n, stops[text + 1] - length + 1 - start - first)
        some = n > 0
        h, n, first, text = h[some], n[some], first[some], text[some]
        # Runs longer than w windows (a minimizer met again, a long repeat) are cut by content: pieces start where a run does.
        if (n > w).any():
            pieces = -(-n // w)
            h, base, text = np.repeat(h, pieces), np.repeat(first, pieces), np.repeat(text, pieces)
            k = np.arange(len(h)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            n = np.minimum(w, np.repeat(n, pieces) - k * w)
            first = base + k * w
        # A fragment is known by the hashes of m bytes that cover it.
        with np.errstate(over="ignore"):
            key, last = h, n + length - 1 - m
            for at in range(0, w + length - 1, m):
                key = _mix(key * C1 + all_h[first + np.minimum(at, last)])
        out.append((text, h, first + start - stops[text], n, key))
    if not out:
        return tuple(np.zeros(0, t) for t in names)
    return tuple(np.concatenate([x[k] for x in out]) for k in range(5))


def share_of(h: np.ndarray, shares: int) -> np.ndarray:
    """Share of each minimizer, whatever its bit 0. A minimizer is the least of several hashes, so its own top bits are uneven."""
    with np.errstate(over="ignore"):
        return ((_mix(h | np.uint64(1)) >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


class Columns:
    """Columns that every round writes anew, front to back and block by block: in memory, or in scratch files beyond `limit` bytes."""

    def __init__(self, limit: int = IN_MEMORY, block: int = BLOCK):
        self.limit, self.block, self.files = limit, block, 0

    def new(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.limit:
            return np.empty(n, dtype)
        self.files += 1
        file = tempfile.TemporaryFile()  # has no name: it goes with the array, whatever becomes of the task
        file.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype, "r+", shape=(n,))

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        for x in range(0, n, self.block):
            yield x, min(n, x + self.block)

    def inserted(self, old: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """`new` comes to stand at the places `at` (rising) of the result."""
        out = self.new(len(old) + len(at), old.dtype)
        for x, y in self.blocks(len(out)):
            i, j = np.searchsorted(at, (x, y))
            keep = np.ones(y - x, bool)
            keep[at[i:j] - x] = False
            part = out[x:y]
            part[keep] = old[x - i : y - j]
            part[at[i:j] - x] = new[i:j]
        return out

    def moved(self, keys: np.ndarray, at: np.ndarray, n: int, mask: np.int64) -> None:
        """Adds to the place in each key how many of the insertions at `at` come before it, in a column that had n entries."""
        shift = self.new(n, np.int32)
        before = at - np.arange(len(at))  # how many old entries come before each
        for x, y in self.blocks(n):
            i, j = np.searchsorted(before, (x, y), "right")
            shift[x:y] = np.repeat(np.arange(i, j + 1, dtype=np.int32), np.diff(np.r_[x, before[i:j], y]))
        for x, y in self.blocks(len(keys)):
            part = keys[x:y]
            part += shift.take(part & mask, mode="clip")

    def least(self, records: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least common prefix among records[low..high] of each pair; parts of a pair in several blocks are put together."""
        out = np.full(len(low), 255, np.uint8)
        first, last = low // self.block, high // self.block
        minima = np.empty(-(-len(records) // self.block), np.uint8)
        for b, (x, y) in enumerate(self.blocks(len(records))):
            common = records[x:y].view(np.uint8)[::8].copy()
            minima[b] = common.min(initial=255)
            some = np.flatnonzero((first == b) | (last == b))
            if len(some):
                part = _range_min(common, np.maximum(low[some] - x, 0), np.minimum(high[some], y - 1) - x)
                out[some] = np.minimum(out[some], part)
        far = np.flatnonzero(last - first > 1)
        if len(far):
            out[far] = np.minimum(out[far], _range_min(minima, first[far] + 1, last[far] - 1))
        return out


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high] for each pair, by tables of minima over powers of two."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    order = np.argsort(level.astype(np.uint8), kind="stable")
    cut = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    out = np.empty(len(low), values.dtype)
    table, size = values, 1
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        at = order[a:b]
        if b > a:
            out[at] = np.minimum(table[low[at]], table[high[at] - size + 1])
        if len(table) > size:
            table = np.minimum(table[:-size], table[size:])
        size *= 2
    return out


def column_wise(fragments: list[bytes], columns: Columns | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of a collection: (owner, suffix length, common prefix with the suffix before), by insertion of one symbol of
    every fragment a round. Symbol 0 ends a fragment; a byte b is symbol b + 1, except that the two largest share
    none: bytes 254 and 255 never occur in UTF-8.

    A record of the transform holds, from the low end, the common prefix (8 bits), the symbol before the suffix (8) and the
    suffix, named by where it starts in the fragments laid end to end, each with an end symbol.
    """
    columns = columns or Columns()
    n, eight, sixteen, bits = len(fragments), np.uint64(8), np.uint64(16), np.int64(40)
    mask = np.int64((1 << 40) - 1)
    sizes = np.fromiter(map(len, fragments), np.int64, n)
    text = np.frombuffer(b"".join(fragments), np.uint8)
    ends = np.cumsum(sizes)
    stops = ends + np.arange(n)
    # Round 0: the empty suffixes, in order of fragments; before each stands the fragment's last symbol.
    symbol = text[ends - 1] + np.uint8(1)
    records = columns.new(n, np.uint64)
    records[:] = stops.astype(np.uint64) << sixteen | symbol.astype(np.uint64) << eight
    # LF: symbol and place of every suffix that has a symbol before it, sorted; the sorted order is that of the extensions.
    active = np.argsort(symbol, kind="stable")
    keys = columns.new(n, np.int64)
    keys[:] = symbol[active].astype(np.int64) << bits | active
    k = np.arange(n)  # of the fragments that still grow, in that order
    for j in range(1, int(sizes.max()) + 1):
        at = n + k
        # Common prefixes of the new suffixes with their neighbours: 1 + the least over the stretch between the two places.
        lower, upper = np.maximum(k - 1, 0), np.minimum(k + 1, len(keys) - 1)
        here, down, up = keys[k], keys[lower], keys[upper]
        prev = np.flatnonzero((k > 0) & (down >> bits == here >> bits))
        nxt = np.flatnonzero((k < upper) & (up >> bits == here >> bits))
        here, down, up = here & mask, down & mask, up & mask
        common = columns.least(records, np.r_[down[prev], here[nxt]] + 1, np.r_[here[prev], up[nxt]]) + np.uint8(1)
        before = np.zeros(len(at), np.uint64)
        before[prev] = common[: len(prev)]
        # Insert: the symbol before each new suffix, 0 where its fragment is used up.
        left = sizes[active] - j
        coming = np.where(left > 0, text[np.maximum(ends[active] - j - 1, 0)] + np.uint8(1), np.uint8(0)).astype(np.int64)
        had = len(records)
        records = columns.inserted(records, at, (stops[active] - j).astype(np.uint64) << sixteen | coming.astype(np.uint64) << eight | before)
        records.view(np.uint8)[8 * (at[nxt] + 1)] = common[len(prev) :]
        # Old places move up by what was inserted before them; the new suffixes join in.
        columns.moved(keys, at, had, mask)
        coming, at, active = (x[left > 0] for x in (coming, at, active))
        new = coming << bits | at
        order = np.argsort(coming.astype(np.uint8), kind="stable")
        new, active = new[order], active[order]
        k = np.searchsorted(keys, new) + np.arange(len(new))
        keys = columns.inserted(keys, k, new)
    suffix = (records >> sixteen).astype(np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)[suffix]
    return owner, (stops[owner] - suffix).astype(np.uint8), records.view(np.uint8)[::8].copy()


def covered_runs(fragments: list[bytes], least_id: np.ndarray, length: int, columns: Columns | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, start, stop) of the bytes of each fragment that windows cover which also start in a text with a smaller id
    than the fragment's own least one: maximal runs, in order of fragments."""
    who, long, lcp = column_wise(fragments, columns)
    group = np.flatnonzero(np.r_[True, lcp[1:] < length])
    lowest = np.repeat(np.minimum.reduceat(least_id[who], group), np.diff(np.r_[group, len(who)]))
    hit = np.flatnonzero((long >= length) & (lowest < least_id[who]))
    sizes = np.array([len(f) for f in fragments])
    of, at = who[hit], sizes[who[hit]] - long[hit]
    order = np.lexsort((at, of))
    of, at = of[order].astype(np.int64), at[order].astype(np.int64)
    if not len(at):
        return of, at, at
    cut = np.flatnonzero((of[1:] != of[:-1]) | (np.diff(at) > length))  # windows that touch form one run
    first, last = np.r_[0, cut + 1], np.r_[cut, len(at) - 1]
    return of[first], at[first], at[last] + length


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end pairs as 64-bit little-endian) per row.

    `length` is 16 at least.
    """
    if length < 16:
        raise ValueError("length has to be 16 at least")
    m = min(MINIMIZER, length // 2)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = text_bytes(base)
    chunks, shares, buckets = (max(12, math.ceil(size / x)) for x in (CHUNK_BYTES, SHARE_BYTES, BUCKET_BYTES))
    base = base.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), "text")
    # A text that a smaller id has too goes as a whole; its windows needn't be looked at. A chunk hands in each text once, so that many
    # copies of one meet as a row for every chunk at most.
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    once = base.where(F.octet_length("text") >= length).groupBy("chunk", digest.alias("digest")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    once = stored(once, "texts")
    owners = once.groupBy("digest").agg(F.min("least").alias("owner"), F.sum("n").alias("copies")).where("copies > 1").select("digest", "owner")
    copies = stored(once.join(owners, "digest").select("chunk", "digest", "owner"), "copies")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw = [x.as_py() for x in batch.column("text").cast(pa.binary())]
            digests = pa.array([hashlib.md5(x).digest() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], digests, pa.array([squeeze(x) for x in raw], pa.binary())], names=["chunk", "doc_id", "digest", "text"])

    rows = base.mapInArrow(pack, "chunk int, doc_id bigint, digest binary, text binary")

    def unpacked(pdf: pd.DataFrame) -> tuple[list[int], list[bytes], list[bytes]]:
        """Ids, digests and texts of a chunk, in an order that every pass gives them."""
        open_ = zstandard.ZstdDecompressor().decompress
        order = sorted(range(len(pdf)), key=list(zip(pdf["doc_id"].tolist(), pdf["digest"])).__getitem__)
        pdf = pdf.iloc[order]
        return pdf["doc_id"].tolist(), pdf["digest"].tolist(), [open_(x) if x else b"" for x in pdf["text"]]

    def owners_only(ids: list[int], digests: list[bytes], texts: list[bytes], found: pd.DataFrame) -> list[bytes]:
        """The texts, empty where a smaller id has the same."""
        owner = dict(zip(found["digest"], found["owner"].tolist()))
        return [b"" if owner.get(d, i) < i else t for i, d, t in zip(ids, digests, texts)]

    def survey(key: tuple, pdf: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        """Distinct minimizers of a chunk by share, and how many distinct fragments each has; the lowest bit tells that two of its
        texts have it."""
        text, every, _, _, keys = minimizer_runs(owners_only(*unpacked(pdf), gone), length, m) if len(pdf) else [np.zeros(0, np.int64)] * 5
        if not len(every):
            return pd.DataFrame({"share": [], "chunk": [], "hashes": [], "counts": []}, dtype="object")
        every = every | np.uint64(1)
        order = np.argsort(every, kind="stable")
        by, of = every[order], text[order]
        starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        h = by[starts]
        several = np.maximum.reduceat(of, starts) != np.minimum.reduceat(of, starts)
        distinct = np.unique(keys, return_index=True)[1]
        counts = np.bincount(np.searchsorted(h, every[distinct]), minlength=len(h)).astype("<u4")
        h = h ^ several.astype(np.uint64)  # bit 0 clear: in several
        share = share_of(h, shares)
        order = np.argsort(share, kind="stable")
        h, counts = h[order], counts[order]
        cut = np.searchsorted(share[order], np.arange(shares + 1))
        some = np.flatnonzero(np.diff(cut))
        squeeze = zstandard.ZstdCompressor(level=1).compress  # nearly all counts are 1
        return pd.DataFrame({"share": some, "chunk": int(key[0]), "hashes": [h[cut[s] : cut[s + 1]].tobytes() for s in some], "counts": [squeeze(counts[cut[s] : cut[s + 1]].tobytes()) for s in some]})

    def repeated(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """For each chunk, which of its minimizers other texts have too; bit 0 marks the hot ones."""
        arrays = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        every = np.concatenate(arrays)
        value, back, n = np.unique(every | np.uint64(1), return_inverse=True, return_counts=True)
        several = np.zeros(len(value), bool)
        several[back[(every & np.uint64(1)) == 0]] = True
        good = (n > 1) | several
        open_ = zstandard.ZstdDecompressor().decompress
        fragments = np.bincount(back, np.concatenate([np.frombuffer(open_(x), "<u4") for x in pdf["counts"]]), len(value))
        value = np.where(fragments > hot, value, value ^ np.uint64(1))
        out, at = [], 0
        for a in arrays:
            b = back[at : at + len(a)]
            out.append(value[b[good[b]]].tobytes())
            at += len(a)
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "hashes": out})

    def fragments(key: tuple, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """Distinct fragments of a chunk under their bucket, numbered, with the places (text of the chunk, byte) that have them;
        the first `top` places are in texts of the least id. Places stay with the chunk, however many there are."""
        names = ["bucket", "fragment", "least", "chunk", "nr", "size", "top", "places"]
        some = found["hashes"].notna()
        value = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in found["hashes"][some]])) if some.any() else np.zeros(0, np.uint64)
        if not len(texts) or not len(value):
            return pd.DataFrame({x: [] for x in names})
        ids, digests, all_texts = unpacked(texts)
        all_texts = owners_only(ids, digests, all_texts, found[~some])
        text, h, first, n, _ = minimizer_runs(all_texts, length, m)
        at = np.minimum(np.searchsorted(value, h & ~np.uint64(1)), len(value) - 1)
        match = np.flatnonzero((value[at] | np.uint64(1)) == (h | np.uint64(1)))
        bucket = ((h[match] >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
        bucket[(value[at[match]] & np.uint64(1)) == 1] = -1
        places: dict[bytes, list[int]] = {}
        bucket_of: list[int] = []
        for i, a, windows, b in zip(text[match].tolist(), first[match].tolist(), n[match].tolist(), bucket.tolist()):
            for x in range(a, a + windows) if b < 0 else (a,):
                fragment = all_texts[i][x : x + length] if b < 0 else all_texts[i][a : a + windows + length - 1]
                old = places.get(fragment)
                if old is None:
                    places[fragment] = [i << 32 | x]
                    bucket_of.append(b if b >= 0 else zlib.crc32(fragment) % buckets)
                else:
                    old.append(i << 32 | x)
        least, top, packed = [], [], []
        for spots in places.values():
            low = ids[spots[0] >> 32]  # texts come in order of their ids
            least.append(low)
            if len(spots) == 1:
                top.append(1)
                packed.append(spots[0].to_bytes(8, "little"))
            else:
                top.append(sum(ids[x >> 32] == low for x in spots))
                packed.append(np.array(spots, "<i8").tobytes())
        return pd.DataFrame({"bucket": bucket_of, "fragment": list(places), "least": least, "chunk": int(key[0]), "nr": np.arange(len(top)), "size": list(map(len, places)), "top": top, "places": packed})

    def collection(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Bucket of fragments -> for each fragment of a chunk, whether all its places lose it (smaller ids elsewhere have it), or else the
        runs of bytes that places in texts of the least id lose. Fragments of which nothing goes there have no row."""
        codes, distinct = pd.factorize(pdf["fragment"])
        own_least = pdf["least"].to_numpy()
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, codes, own_least)
        of, start, stop = covered_runs(list(distinct), least, length)
        cut = np.searchsorted(of, np.arange(len(distinct) + 1))
        pairs = np.stack([start, stop], 1).astype("<i4")
        whole = own_least > least[codes]
        some = np.flatnonzero(whole | (np.diff(cut)[codes] > 0))
        runs = [b"" if whole[k] else pairs[cut[codes[k]] : cut[codes[k] + 1]].tobytes() for k in some]
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[some], "nr": pdf["nr"].to_numpy()[some], "whole": whole[some], "runs": runs})

    def lost(found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, stop) of all bytes that go from a chunk, in order: what its buckets answered, at the places that the chunk has kept."""
        kept, told = found[found["places"].notna()], found[found["runs"].notna()]
        if not len(kept):
            return (np.zeros(0, np.int64),) * 3
        kept = kept.sort_values("nr", ignore_index=True)  # 0, 1, 2, ...
        whole_of, runs_of = np.zeros(len(kept), bool), [b""] * len(kept)
        for k, whole, runs in zip(told["nr"].astype(np.int64).tolist(), told["whole"].tolist(), told["runs"]):
            whole_of[k], runs_of[k] = whole, runs
        n = kept["places"].map(len).to_numpy() // 8
        spot = np.frombuffer(b"".join(kept["places"]), "<i8")
        of, nth = np.repeat(np.arange(len(kept)), n), np.arange(len(spot)) - np.repeat(np.cumsum(n) - n, n)
        # A text with a larger id than the fragment's least loses it all, one with the least id what the marks say.
        whole = whole_of[of] | (nth >= np.repeat(kept["top"].to_numpy(np.int64), n))
        count = np.array([len(x) // 8 for x in runs_of])
        pairs = np.frombuffer(b"".join(runs_of), "<i4").reshape(-1, 2).astype(np.int64)
        some = np.flatnonzero(~whole & (count[of] > 0))
        runs = count[of[some]]
        run = np.repeat((np.cumsum(count) - count)[of[some]] - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
        row = np.repeat(some, runs)
        at = spot & 0xFFFFFFFF
        text = np.r_[spot[whole] >> 32, spot[row] >> 32]
        start = np.r_[at[whole], at[row] + pairs[run, 0]]
        stop = np.r_[at[whole] + kept["size"].to_numpy(np.int64)[of[whole]], at[row] + pairs[run, 1]]
        order = np.lexsort((start, text))
        return text[order], start[order], stop[order]

    def strip(key: tuple, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids, digests, all_texts = unpacked(texts) if len(texts) else ([], [], [])
        owned = owners_only(ids, digests, all_texts, found[found["digest"].notna()])
        text_of, *ends = lost(found)
        spans = np.stack(ends, 1)
        cut = np.searchsorted(text_of, np.arange(len(ids) + 1))
        out = []
        for k, (i, text) in enumerate(zip(ids, all_texts)):
            runs: list[list[int]] = [[0, len(text)]] if text and not owned[k] else []
            for a, b in spans[cut[k] : cut[k + 1]].tolist() if not runs else []:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append((i, len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), np.array(runs, "<i8").tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    surveyed = rows.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInPandas(survey, "share int, chunk int, hashes binary, counts binary")
    answers = surveyed.groupBy("share").applyInPandas(repeated, "chunk int, hashes binary")
    nothing = lambda kind: F.lit(None).cast(kind)
    told = answers.select("chunk", "hashes", nothing("binary").alias("digest"), F.lit(0).cast("bigint").alias("owner"))
    told = told.unionAll(copies.select("chunk", nothing("binary").alias("hashes"), "digest", "owner"))
    cut = rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(fragments, "bucket bigint, fragment binary, least bigint, chunk int, nr int, size int, top int, places binary")
    cut = stored(cut, "fragments")
    answered = cut.select("bucket", "fragment", "least", "chunk", "nr").groupBy("bucket").applyInPandas(collection, "chunk int, nr int, whole boolean, runs binary")
    empty = {"nr": "int", "size": "int", "top": "int", "places": "binary", "whole": "boolean", "runs": "binary", "digest": "binary", "owner": "bigint"}
    whole_row = lambda df: df.select("chunk", *[F.col(c) if c in df.columns else (F.lit(0).cast(kind) if c == "owner" else nothing(kind)).alias(c) for c, kind in empty.items()])  # noqa: E731 - ids are never null: they would become floats
    answers = whole_row(cut.select("chunk", "nr", "size", "top", "places")).unionAll(whole_row(answered)).unionAll(whole_row(copies))
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(strip, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LOWEST)))
