"""Media columns: interleaved document sequences.

A page's HTML becomes an ordered array of items, text or media; a media item carries the reference it was given and the
caption beside it. Media are stored once a digest, losslessly, as 8-bit greyscale images; references meet them in a
join on the digest, and position and caption travel with the reference, so they stay aligned whatever order rows
come back in.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read

#: Pixels of a row of the stored image; a payload is padded with bytes 0 to a positive multiple.
WIDTH = 64
LEVEL = 1
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"

#: Elements that end a run of text, elements that refer to media, and elements whose content is not text.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
MEDIA = {"img", "video", "audio", "source", "embed"}
SILENT = {"script", "style", "template", "noscript"}
#: A tag's rest ends at the next < outside quotes, closed or not: each part of a page is read once, however many tags are left open.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!?(/?)([A-Za-z][A-Za-z0-9-]*+)((?:\"[^\"<>]*+\"|'[^'<>]*+'|\"(?=[^\"]*+\")[^\"]*+\"|'(?=[^']*+')[^']*+'|[^<>\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)


def sequence(page: str) -> list[dict]:
    """Items of a page in the order of its HTML. A figure's caption goes to the media in it, else the alt text does."""
    out: list[dict] = []
    words: list[str] = []
    figure: list[dict] | None = None
    caption: list[str] | None = None
    silent, at = "", 0

    def close() -> None:
        text = "".join(words).strip()
        words.clear()
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "ref": None, "caption": None})

    def take(piece: str) -> None:
        if piece and not silent:
            (words if caption is None else caption).append(html.unescape(piece) if "&" in piece else piece)

    for m in TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if silent:
            silent = "" if m[1] and name == silent else silent
        elif name in SILENT and not m[1]:
            silent = name
        elif name == "figcaption":
            if m[1] and caption is not None:
                said = "".join(caption).strip()
                for item in figure or ():
                    item["caption"] = said
                caption = None
            elif not m[1]:
                close()
                caption = []
        elif name in MEDIA and not m[1]:
            given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3])}
            if given.get("src"):
                close()
                out.append({"position": len(out), "kind": "media", "text": None, "ref": given["src"], "caption": given.get("alt") or None})
                if figure is not None:
                    figure.append(out[-1])
        elif name in BLOCKS:
            close()
            if name == "figure":
                figure = None if m[1] else []
                caption = None
    take(page[at:])
    close()
    return out


def interleave(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key and items array<struct<position, kind, text, ref, caption>>.

    Null and empty pages have no items. Unclosed tags and comments end with the page. Repeated rows give repeated rows.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        form = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sequence(p or "") for p in part.column(1).to_pylist()], form)], [key, "items"])

    return map_arrow(pages.select(key, F.col(column).alias("html")), run, f"{key} {kind}, items array<{ITEM}>")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def encode(payload: bytes) -> bytes:
    """A greyscale PNG of WIDTH 8-bit samples a row, all rows unfiltered. The payload is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = WIDTH.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, LEVEL)) + _chunk(b"IEND", b"")


def decode(stored: bytes) -> bytes:
    """Samples of an image that encode() made."""
    at, body, height = 8, b"", 0
    while at < len(stored):
        n, kind = int.from_bytes(stored[at : at + 4], "big"), stored[at + 4 : at + 8]
        if kind == b"IHDR":
            height = int.from_bytes(stored[at + 12 : at + 16], "big")
        elif kind == b"IDAT":
            body += stored[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, WIDTH + 1)[:, 1:].tobytes()


def store(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """digest, n_bytes, media: one row for each different payload (null as empty). The digest is sha2-256 of the unpadded bytes."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                seen: dict[str, tuple[int, bytes]] = {}
                for x in batch.slice(a, 512).column(0):
                    raw = x.as_py()
                    digest = hashlib.sha256(raw).hexdigest()
                    if digest not in seen:
                        seen[digest] = (len(raw), encode(raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))))
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([m for _, m in seen.values()], pa.binary())], ["digest", "n_bytes", "media"])

    made = map_arrow(payloads.select(F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("payload")), run, "digest string, n_bytes long, media binary")
    return made.dropDuplicates(["digest"])


def features(media: DataFrame) -> DataFrame:
    """Read each stored form back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature beside digest and n_bytes.

    The feature names the image's shape, mean, standard deviation and a 64-bit average hash of its samples in 64 bands.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for digest, n, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                stored = stored.as_py()
                payload = decode(stored)
                x = np.frombuffer(payload, np.uint8)
                bands = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
                bits = int("".join("1" if b else "0" for b in bands > bands.mean()), 2)
                feature = f"png;{WIDTH}x{len(x) // WIDTH};mean={x.mean():.4f};sd={x.std():.4f};bands={bits:016x}"
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_arrow(media, run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(sequences: DataFrame, media: DataFrame, key: str = "page_id", scheme: str = "sha256:") -> DataFrame:
    """One row for each media item: key, position, caption, ref and the columns of `media` whose digest it names.

    A reference that names no stored digest keeps its row, with nulls.
    """
    items = sequences.select(key, F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("i")).select(key, "i.position", "i.caption", "i.ref")
    items = items.withColumn("digest", F.when(F.col("ref").startswith(scheme), F.substring("ref", len(scheme) + 1, 64)))
    return items.join(media, "digest", "left")


def document_page(text, digest):
    """A page of a document: its lines as paragraphs, and after the first the whole text as a figure captioned by that line."""
    safe = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first = F.substring_index(safe, "\n", 1)
    rest = F.substring(safe, F.length(first) + F.lit(2), F.length(safe))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), first, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.lit("<p>"), F.replace(rest, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article>"))


def op1_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents")
    pages = docs.select("doc_id", document_page(text, F.sha2(text.cast("binary"), 256)).alias("html"))
    read_back = features(store(docs, "text"))
    found = resolve(interleave(pages, "doc_id"), read_back, "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", F.sha2(F.coalesce("caption", F.lit("")), 256).alias("caption_sha256"))
