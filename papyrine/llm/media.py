"""Media columns: interleaved document sequences with media resolved by digest.

HTML is parsed into the ordered sequence of its texts and media references. A media store holds each distinct payload
once, under its SHA-256 digest, as an image file of 8-bit grey samples (PNG, lossless). A join on the digest resolves
the references; every item keeps its position and caption, so texts, media and captions stay aligned.

Payloads are never shuffled: the store is written to the shared folder by the tasks that make it, features are
computed where the stored bytes are read back, and only digests and features meet in the join of two tables, which Spark
splits at hot digests.

Defined cases: null text counts as empty; the payload is never empty (padded to a positive multiple of 64 bytes);
equal texts give equal values; a reference without a payload stays in its place with null media columns; null or
empty HTML gives an empty sequence; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import map_columns, written

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "pos int, kind string, text string, ref string, caption string"
MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src"}
SILENT = frozenset(("script", "style", "head", "template", "noscript"))
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class Sequence(HTMLParser):
    """Collects [kind, text, ref, caption] in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list[str | None]] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.silent = 0

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        if said:
            self.items.append(["text", said, None, None])
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in MEDIA:
            found = dict(attrs)
            if ref := found.get(MEDIA[tag]):
                self.flush()
                self.items.append(["media", None, ref, found.get("alt")])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for item in self.items[self.figure or 0 :] if self.figure is not None else self.items[-1:]:
                if item[0] == "media":
                    item[3] = said
            self.caption = None
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The items of one page, positions from 0."""
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"pos": k, "kind": i[0], "text": i[1], "ref": i[2], "caption": i[3]} for k, i in enumerate(parser.items)]


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, items array<struct>) for every row of pages."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {key: b[key], "items": [sequence(h) for h in b[html]]}

    return map_columns(pages.select(F.col(key).cast("long"), html), run, f"{key} long, items array<struct<{ITEMS.replace(' ', ':').replace(',:', ',')}>>")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pack(payload: bytes, level: int = 2) -> bytes:
    """A grey 8-bit PNG, WIDTH samples a row, whose samples are the payload (a positive multiple of WIDTH bytes)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 at the head of each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def unpack(media: bytes) -> bytes:
    """The samples of such a PNG; checks signature, checksums and size."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, size, data = len(SIGNATURE), (0, 0), b""
    while at < len(media):
        if at + 12 > len(media) or at + 12 + struct.unpack_from(">I", media, at)[0] > len(media):
            raise ValueError("a chunk is cut off")
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that pack() does not use")
    return rows[:, 1:].tobytes()


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros appended up to a positive multiple of WIDTH, and the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0"), len(raw)


def image_feature(samples: bytes) -> str:
    """Size, mean, deviation and a 16-bin histogram in permille of the grey samples."""
    a = np.frombuffer(samples, np.uint8)
    bins = np.bincount(a >> 4, minlength=16) * 1000 // len(a)
    mean = a.mean(dtype=np.float64)
    return f"{WIDTH}x{len(a) // WIDTH};mean={mean:.3f};dev={a.std(dtype=np.float64):.3f};hist={','.join(map(str, bins.tolist()))}"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page rows, media rows) of docs(doc_id, text): a page doc_id, html that shows the text's payload as a figure,
    and the media table digest, media with each payload once a task. Both come from one written table."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set[bytes] = set()
        for b in batches:
            html, digests, media = [], [], []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                data, n = payload(text)
                key = hashlib.sha256(data + b"%d" % n).digest()
                html.append(f'<figure><img src="sha256:{key.hex()}"><figcaption>text of {n} bytes</figcaption></figure>')
                digests.append(key.hex())
                media.append(None if key in seen else struct.pack("<Q", n) + pack(data))
                if len(seen) < 200_000:
                    seen.add(key)
            yield {"doc_id": b["doc_id"], "html": html, "digest": digests, "media": media}

    made = written(map_columns(docs.select("doc_id", "text"), run, "doc_id long, html string, digest string, media binary"), "media")
    return made.select("doc_id", "html"), made.filter("media is not null").select("digest", "media")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes say, one row a digest: digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for digest, stored in zip(b["digest"], b["media"]):
                n, png = struct.unpack_from("<Q", stored)[0], stored[8:]
                samples = unpack(png)
                row = (digest, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(png), hashlib.sha256(png).hexdigest(), image_feature(samples))
                for name, x in zip(out, row):
                    out[name].append(x)
            yield out

    kinds = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return written(map_columns(media, run, kinds).distinct(), "features")  # a digest may come from several tasks; its rows are equal


def resolve(items: DataFrame, key: str, features: DataFrame) -> DataFrame:
    """One row an item: key, pos, kind, text, caption and the media columns of its reference (null for text)."""
    long = items.select(key, F.explode("items").alias("i")).select(key, "i.pos", "i.kind", "i.text", "i.caption", F.regexp_extract(F.coalesce("i.ref", F.lit("")), r"\Asha256:([0-9a-f]{64})\z", 1).alias("digest"))
    return written(long, "items").join(features, "digest", "left")


def assemble(resolved: DataFrame, key: str) -> DataFrame:
    """Back to one row a document: key and its items in order, media resolved."""
    cols = [c for c in resolved.columns if c not in (key, "pos")]
    return resolved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("items"))
