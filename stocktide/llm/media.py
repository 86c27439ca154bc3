"""Interleaved document sequences: ordered text and media references whose payloads are found by digest.

`interleave` parses HTML into one array of structs per document, in reading order; a media struct has the digest it
refers to and its caption. `media_store` holds payloads losslessly as 8-bit greyscale PNGs. `resolve` joins the references
to the store by digest, and `aligned` puts the results back to their positions.

Cases: null or empty HTML gives an empty sequence; very long texts are payloads of many rows of samples; a reference without a
stored payload keeps its place with null results; a caption belongs to the last media element of its <figure> (without a caption: the
alt text), one outside of figures is text, and one left open ends with its figure or the page; a <body> ends an unclosed <head>; equal
payloads are stored under one digest and read back once; repeated rows give equal rows; extra input columns are kept only when named.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import kept_as, slices, with_fields

WIDTH = 64
LEVEL = 3
KNOWN = 1 << 16  # digests that a task remembers
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
RESULT = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
PNG_MARK = b"\x89PNG\r\n\x1a\n"
HIDDEN = {"script", "style", "head", "template"}
MEDIA = {"img", "audio", "video", "source", "embed"}
BLOCKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "table", "tr", "blockquote", "ul", "ol", "pre"}


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure: int | None = None  # where the open figure's items start

    def flush(self) -> None:
        if self.caption is not None:
            self.end_caption()
        if text := " ".join("".join(self.words).split()):
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def end_caption(self) -> None:
        """The caption goes to the figure's last media item; elsewhere it is text."""
        text, self.caption = " ".join("".join(self.caption or []).split()), None
        media = [x for x in self.items[self.figure :] if x["kind"] == "media"] if self.figure is not None else []
        if text and media:
            media[-1]["caption"] = text
        elif text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "body":
            self.hidden = 0
        elif tag in MEDIA and a.get("src"):
            self.flush()
            self.items.append({"kind": "media", "text": None, "digest": a["src"].removeprefix(SCHEME), "caption": a.get("alt") or None})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCKS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.flush()
            self.figure = len(self.items)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag in BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit greyscale PNG, a row for every `width` bytes; the length has to be a positive multiple of it."""
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return PNG_MARK + part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + part(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples, row by row, of an 8-bit greyscale PNG with unfiltered rows."""
    if media[:8] != PNG_MARK:
        raise ValueError("not a PNG")
    at, data, shape = 8, b"", (0, 0)
    while at < len(media):
        (size,), name = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if name == b"IHDR":
            w, h, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit greyscale is stored here")
            shape = (h, w)
        elif name == b"IDAT":
            data += body
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are stored here")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, variance, entropy and an average hash over an 8 x 8 grid of the samples."""
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256).astype(np.float64)
    p, values = counts / len(flat), np.arange(256)
    mean = float((p * values).sum())
    some = p[p > 0]
    rows = [r for r in np.array_split(samples, 8)]
    grid = np.array([[c.mean() if c.size else 0.0 for c in np.array_split(r, 8, axis=1)] for r in rows]).ravel()
    bits = int("".join("1" if x > mean else "0" for x in grid), 2)
    return f"mean={mean:.6f};var={float((p * (values - mean) ** 2).sum()):.6f};entropy={float(-(some * np.log2(some)).sum()):.6f};ahash={bits:016x}"


def interleave(docs: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The `keep` columns and `items`, an array of (position, kind, text, digest, caption); a kept column of that name comes as `doc_items`."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="_html"):
            items = pa.array([parse_html(x) for x in batch.column("_html").to_pylist()], pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], items], names=[*batch.schema.names[:-1], "items"])

    rows = docs.select(*kept_as(keep, ("items", "_html")), F.col(html_col).cast("string").alias("_html"))
    return rows.mapInArrow(parse, with_fields(rows.drop("_html").schema, f"items array<{ITEM}>"))


def payload_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a padded payload in its stored form, and a small page that shows it by digest.

    A null text is empty; padding with zero bytes makes at least one row of samples.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digests, pages, media = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode()
                payload = raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))
                digest = hashlib.sha256(payload).hexdigest()
                n.append(len(raw))
                digests.append(digest)
                pages.append(f'<article><h1>Document {doc_id}</h1><figure><img src="{SCHEME}{digest}"><figcaption>Text of document {doc_id}, {len(raw)} bytes</figcaption></figure></article>')
                media.append(encode_png(payload))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "html", "digest", "media"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id bigint, n_bytes bigint, html string, digest string, media binary")


def media_store(rows: DataFrame) -> DataFrame:
    """Reads every stored payload back; one row of features per digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}  # copies in one task are decoded once
        for batch in slices(batches, column="media"):
            out: list[list] = [[] for _ in range(7)]
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media")):
                media = media.as_py()
                form = hashlib.sha256(media).hexdigest()
                if (digest, form) in known:
                    continue
                if len(known) >= KNOWN:
                    known.clear()
                known[digest, form] = ()
                samples = decode_png(media)
                payload = samples.tobytes()
                for c, v in zip(out, (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), form, feature(samples))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (1, 3, 4) else pa.string()) for k, c in enumerate(out)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = rows.select("digest", "media").mapInArrow(read, RESULT)
    names = [c for c in found.columns if c != "digest"]
    return found.groupBy("digest").agg(F.max(F.struct(*names)).alias("media")).select("digest", "media")


def resolve(sequences: DataFrame, store: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row per item of each sequence; media items get what the store has under their digest."""
    items = sequences.select(*keep, F.explode("items").alias("item")).select(*keep, "item.*")
    return items.join(store, "digest", "left")


def aligned(resolved: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Items back in one array per document, in order of position."""
    item = F.struct("position", "kind", "text", "digest", "caption", "media")
    return resolved.groupBy(*keep).agg(F.array_sort(F.collect_list(item)).alias("items"))
