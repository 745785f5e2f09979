"""Media columns: documents as sequences of text and media references, payloads found by digest."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import blob, stored, table

#: Samples in a row of an image, to a multiple of which payloads are padded; bytes of the tail that is check-summed.
WIDTH, TAIL = 64, 64
#: Digests that a writing task remembers, so that it stores no payload twice in a row of copies.
REMEMBERED = 100_000
_PNG = b"\x89PNG\r\n\x1a\n"  # fixed by the format
_MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "pre", "article", "section", "figure", "br", "title", "tr"}
_SKIPPED = {"script", "style", "noscript", "template"}
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


# ---------------------------------------------------------------- payloads


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes((-len(data)) % WIDTH if data else WIDTH)


def encode_image(payload: bytes) -> bytes:
    """payload as the 8-bit grey samples of a PNG of WIDTH columns, lossless."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter type of 0 before each row
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_image(data: bytes) -> np.ndarray:
    """The samples of a PNG that encode_image() made, as rows; checksums are verified."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, parts, shape = 8, [], (0, 0)
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a row filter that isn't written here")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean and spread in thousandths, distinct values, and a 64-bit hash of brightness by eighths (integers only)."""
    n, flat = samples.size, samples.ravel()
    counts = np.bincount(flat, minlength=256)
    total = int(counts @ np.arange(256))
    square = int(counts @ np.arange(256) ** 2)
    h = len(samples)
    cut = np.arange(9) * h // 8
    sums = np.concatenate((np.zeros((1, WIDTH), np.int64), np.cumsum(samples, 0, dtype=np.int64)))
    cells = (sums[cut[1:]] - sums[cut[:-1]]).reshape(8, 8, WIDTH // 8).sum(2)
    area = ((cut[1:] - cut[:-1]) * (WIDTH // 8))[:, None]
    bits = (cells * n > total * area).ravel()
    code = int("".join("1" if b else "0" for b in bits), 2)
    return f"{samples.shape[1]}x{h};mean={total * 1000 // n};var={(square * n - total * total) * 1000 // (n * n)};values={int((counts > 0).sum())};hash={code:016x}"


# ---------------------------------------------------------------- store


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: OrderedDict[bytes, None] = OrderedDict()
    for batch in batches:
        chars, bounds = blob(batch.column(0))
        names, images, size = [], [], 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            payload = padded(chars[a:b].tobytes())
            name = hashlib.sha256(payload)
            if name.digest() in seen:
                seen.move_to_end(name.digest())
                continue
            seen[name.digest()] = None
            if len(seen) > REMEMBERED:
                seen.popitem(last=False)
            names.append(name.hexdigest())
            images.append(encode_image(payload))
            size += len(images[-1])
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(images, pa.binary())], ["digest", "media"])
                names, images, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(images, pa.binary())], ["digest", "media"])


def store_payloads(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(digest, media): the first column of texts as UTF-8 (null: empty), padded, as images in a stored table, named by the
    SHA-256 of the payload. A task writes equal payloads once; several tasks may write the same one."""
    return stored(spark, texts.mapInArrow(_store, "digest string, media binary"), "media")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, media in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = media.as_buffer().to_pybytes()
            samples = decode_image(data)
            payload = samples.tobytes()
            code = hashlib.sha256(payload).hexdigest()
            if code != name:
                raise ValueError(f"the payload of {name} does not have its digest")
            out.append((name, len(payload), code, zlib.crc32(payload[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 7, kinds)], names)


def media_features(media: DataFrame) -> DataFrame:
    """One row for each digest of media(digest, media): sizes, digests and features of the samples read back."""
    rows = media.select("digest", "media").mapInArrow(_features, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.dropDuplicates(["digest"])


# ---------------------------------------------------------------- sequences


class _Interleaver(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip, self.caption, self.figure = 0, False, -1

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        if self.caption and self.figure >= 0 and any(x["kind"] != "text" for x in self.items[self.figure :]):
            for x in self.items[self.figure :]:  # a caption belongs to all media of its figure
                if x["kind"] != "text":
                    x["caption"] = text
            return
        self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.skip += 1
        elif tag in _MEDIA_TAGS:
            self.flush()
            a = dict(attrs)
            ref = a.get("src") or a.get("data-src") or next(iter((a.get("srcset") or a.get("data-srcset") or "").replace(",", " ").split()), None)
            if ref:
                self.items.append({"kind": _MEDIA_TAGS[tag], "text": None, "ref": ref, "caption": a.get("alt") or None})
        elif tag == "figcaption":
            self.flush()
            self.caption = True
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.flush()
            self.caption = False
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = -1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def interleave(html: str | None) -> list[dict]:
    """The ordered text and media-reference items of a page. A media item's caption is its figure's, else its alt text;
    positions count from 0; scripts and styles are left out; null or empty html has none."""
    p = _Interleaver()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": k, **x} for k, x in enumerate(p.items)]


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, items) for every row of pages(key, html, ...); see interleave()."""
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([interleave(x) for x in batch.column(1).to_pylist()], pa.list_(item))], [key, "items"])

    return pages.select(key, "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, items {SEQUENCE}")


def resolve(found: DataFrame, media: DataFrame, key: str = "page_id", refs: DataFrame | None = None) -> DataFrame:
    """A row for each item of found(key, items), with the columns that media has for its digest: the one in a ref
    "sha256:<digest>", else the one that refs(ref, digest) has for the ref (the smallest, if it has several). Both are
    equi-joins, so equal payloads are handled once. Items stay where they are: position, kind, text and caption come
    along; texts and unknown references have nulls."""
    items = found.select(key, F.inline("items")).withColumn("digest", F.when(F.col("ref").startswith("sha256:"), F.substring_index("ref", ":", -1)))
    if refs is not None:
        known = refs.groupBy(F.col("ref").alias("known")).agg(F.min("digest").alias("named"))
        items = items.join(known, F.col("ref") == F.col("known"), "left").withColumn("digest", F.coalesce("digest", "named")).drop("known", "named")
    return items.join(media, "digest", "left")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document becomes a page of its text and a figure that refers to its payload by digest; the payload is stored as an
    image, read back and described once for each digest, and found through the page's reference. Rows equal in doc_id and text are told
    apart by nothing and get equal results; null doc_ids pass through."""
    docs = table(spark, sf_dir, "documents")
    data = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", data.cast("binary").alias("data"), F.octet_length(data).cast("long").alias("n_bytes"))
    short = F.when(F.col("n_bytes") == 0, WIDTH).otherwise(F.pmod(-F.col("n_bytes"), F.lit(WIDTH))).cast("int")
    digest = F.sha2(F.concat("data", F.unhex(F.repeat(F.lit("00"), short))), 256)
    escaped = F.replace(F.replace(F.replace(F.col("data").cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<article><p>"), escaped, F.lit("</p><figure><img src=\"sha256:"), digest, F.lit("\" alt=\"payload\"><figcaption>"), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure></article>"))
    pages = own.select(F.struct("doc_id", "n_bytes").alias("doc"), page.alias("html"))
    media = media_features(store_payloads(spark, docs.select("text")))
    rows = resolve(sequences(pages, "doc"), media, "doc").where("kind = 'image'")
    return rows.select("doc.doc_id", "doc.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
