"""Interleaved document sequences: HTML to ordered text and media references, payloads resolved by digest.

Media are held apart from documents, keyed by the digest of their payload, as PNG images of 8-bit samples.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, blocks, map_texts, materialize

#: Samples in a row of an image; payloads are padded to a multiple of it.
ROW = 576
PAD = b"\xff"
PNG = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,chars:int,ref:string,caption:string>>"


def pad(raw: bytes) -> bytes:
    """To a positive multiple of ROW, with bytes 255, which UTF-8 never has."""
    return raw + PAD * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, ROW wide, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    body = np.zeros((len(rows), ROW + 1), np.uint8)
    body[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png wrote; a damaged one is an error."""
    if data[: len(PNG)] != PNG:
        raise ValueError("not a PNG")
    at, body, size = len(PNG), b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + chunk):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            size = struct.unpack(">II", chunk[:8])
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)
    return rows[:, 1:].tobytes()


class _Reader(HTMLParser):
    """Text runs and media references in document order; a figure's last caption goes to the media before it in the figure.

    A caption ends with its tag, with its figure, where another one begins and with the page.
    """

    BREAK = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 article section table ul ol figure blockquote pre header footer".split())
    SKIP = frozenset("script style template noscript".split())
    MEDIA = frozenset("img video audio source".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.caption: list[str] | None = None
        self.skipped = 0
        self.figures: list[tuple[int, tuple[int, str] | None]] = []
        self.captions: list[tuple[int, int, str]] = []

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "chars": len(text), "ref": None, "caption": None})

    def end_caption(self):
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            if text and self.figures:
                self.figures[-1] = (self.figures[-1][0], (len(self.items), text))
            self.caption = None

    def end_figure(self):
        self.end_caption()
        if self.figures:
            start, last = self.figures.pop()
            if last:
                self.captions.append((start, *last))

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        if tag in self.BREAK or tag in self.MEDIA or tag == "figcaption":
            self.flush()
        if tag == "figure":
            self.figures.append((len(self.items), None))
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in self.MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.items.append({"kind": tag, "text": None, "chars": None, "ref": a["src"], "caption": a.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        if tag in self.BREAK:
            self.flush()
        if tag == "figcaption":
            self.end_caption()
        if tag == "figure":
            self.end_figure()

    def handle_data(self, data):
        if not self.skipped:
            (self.run if self.caption is None else self.caption).append(data)

    def finish(self) -> list[dict]:
        """All items. Of captions that hold for one medium, that of the figure that ended last counts; each item is met once."""
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()
        following = list(range(len(self.items) + 1))
        for start, stop, text in reversed(self.captions):
            i = start
            while (i := self._free(following, i)) < stop:
                if self.items[i]["kind"] != "text":
                    self.items[i]["caption"] = text
                following[i] = i + 1
        return self.items

    @staticmethod
    def _free(following: list[int], i: int) -> int:
        """The first item from i on that no caption has been met with; paths are halved on the way."""
        while following[i] != i:
            following[i] = following[following[i]]
            i = following[i]
        return i


#: A declaration `<![...>` that is no tag, up to its end.
_DECLARATION = re.compile(r"<!\[[^>]*>")


def _plain(page: str) -> str:
    """The page without what the parser cannot end: declarations in brackets go, and openings that nothing closes become text.

    So no page stops the parser, and none makes it look for one and the same end from many places.
    """
    last = page.rfind(">")
    head, rest = _DECLARATION.sub("", page[: last + 1]), page[last + 1 :].replace("<", "&lt;")
    closed = head.rfind("-->")
    return (head[: closed + 1] + head[closed + 1 :].replace("<!--", "&lt;!--") + rest).replace("<![", "&lt;![")


def parse(page: str | None) -> list[dict]:
    """The sequence of a page; null and empty pages have none, broken ones what can be read."""
    r = _Reader()
    r.feed(_plain(page or ""))
    r.close()
    return [{"position": i} | x for i, x in enumerate(r.finish())]


def sequences(pages: DataFrame, keep=("page_id",), text: str = "html") -> DataFrame:
    """Per page its `sequence`: text and media in document order, with positions and captions.

    Null, empty and broken pages give what can be read, maybe an empty array; no page stops the job, and a page takes time in
    proportion to its length. Repeated pages stay. Other columns are not read. Narrow.
    """
    return map_texts(pages, lambda: lambda texts: {"sequence": [parse(t) for t in texts]}, f"sequence {SEQUENCE}", keep, text)


def resolve(rows: DataFrame, media: DataFrame) -> DataFrame:
    """The rows with, in every item of their `sequence`, a field `media`: the columns of the media with the item's ref.

    media: one row per `ref`, and other columns. Items keep their order, positions and captions; text, and refs that `media`
    lacks, get a null. Only references are joined. `media` should be a stored table: then Spark itself splits a payload that
    very many items share among tasks. What is found comes back to its row by the item's position. Rows need no unique key and stay as often as they stand.
    """
    held = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
    refs = held.select("__row", F.explode("sequence").alias("s")).select("__row", "s.position", "s.ref").filter(F.col("ref").isNotNull())
    found = refs.join(media, "ref").select("__row", "position", F.struct(*[c for c in media.columns if c != "ref"]).alias("media"))
    found = found.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("position", "media"))).alias("__found"))
    joined = held.join(found, "__row", "left")
    resolved = F.transform("sequence", lambda item: item.withField("media", F.try_element_at(F.col("__found"), item["position"])))
    return joined.withColumn("sequence", resolved).drop("__row", "__found")


def feature(payload: bytes) -> str:
    """Rows, least, largest and mean sample (in thousandths) and shares of sixteen bands (in ten thousandths)."""
    a = np.frombuffer(payload, np.uint8)
    bands = np.bincount(a >> 4, minlength=16) * 10000 // len(a)
    return f"rows={len(a) // ROW};min={a.min()};max={a.max()};mean={int(a.sum(dtype=np.int64)) * 1000 // len(a)};bands=" + ",".join(map(str, bands))


def _packed(batches):
    names = ["ref", "n_bytes", "media"]
    for block in blocks(batches, "text"):
        made: dict[str, tuple] = {}
        for t in block.column("text").to_pylist():
            raw = (t or "").encode("utf-8", "surrogatepass")
            ref = "sha256:" + hashlib.sha256(payload := pad(raw)).hexdigest()
            if ref not in made:
                made[ref] = (ref, len(raw), to_png(payload))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made.values(), strict=True)], names=names)


def _described(batches):
    for batch in batches:
        rows = []
        for ref, n, data in zip(*(batch.column(c).to_pylist() for c in ("ref", "n_bytes", "media")), strict=True):
            payload = from_png(data)
            rows.append((ref, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in DESCRIBED.split(", ")])


DESCRIBED = "ref string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pack(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stored media of the texts: ref (digest of the padded payload), n_bytes (unpadded) and the image.

    Written to the shared folder and read back, so whatever reads it reads stored bytes. Copies within a block are stored
    once, those of different blocks again; describe() leaves one row per digest.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    source = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return materialize(source.mapInArrow(_packed, "ref string, n_bytes long, media binary"))


def describe(media: DataFrame) -> DataFrame:
    """One row per digest, computed from the stored bytes: sizes, digests, tail checksum and feature.

    Features are small, so only they are grouped; images stay where they are stored.
    """
    rest = [c.split()[0] for c in DESCRIBED.split(", ")[1:]]
    return media.mapInArrow(_described, DESCRIBED).groupBy("ref").agg(*[F.max(c).alias(c) for c in rest])


def page_of(text: str | None) -> str:
    """A document as a page: its lines as paragraphs, then its media with a caption."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = "".join(f"<p>{html.escape(x, quote=False)}</p>" for x in (text or "").split("\n") if x.strip())
    return f'<article>{lines}<figure><img src="sha256:{hashlib.sha256(pad(raw)).hexdigest()}"><figcaption>{len(raw)} bytes</figcaption></figure></article>'


def media_of_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document its sequence, and of its media, resolved by digest: sizes, payload and media digests and feature.

    A document's sequence: its lines, by their lengths (the text itself stays in the document), then its media with a
    caption; `sequence` holds every item with its position, `position` and `caption` are those of the media. Null counts
    as empty text, whose payload is one row of padding. Equal texts agree; repeated rows and ids stay. Only light
    sequences, references and features are shuffled.
    """

    def work(texts):
        return {"sequence": [[x | {"text": None} for x in parse(page_of(t))] for t in texts]}

    rows = resolve(map_texts(docs, lambda: work, f"sequence {SEQUENCE}", ("doc_id",), text), materialize(describe(pack(docs, text))))
    own = F.filter("sequence", lambda item: item["ref"].isNotNull())[0]
    rows = rows.withColumn("__own", own)
    made = [F.col(f"__own.media.{c.split()[0]}") for c in DESCRIBED.split(", ")[1:]]
    return rows.select("doc_id", *made, "__own.position", "__own.caption", "sequence")


def page_sequences(pages: DataFrame) -> DataFrame:
    """Per page how many items, texts and media its sequence has, the characters of its texts, and the sequence itself."""
    rows = sequences(pages, ("page_id",))
    texts = F.filter("sequence", lambda item: item["kind"] == "text")
    chars = F.aggregate(texts, F.lit(0).cast("long"), lambda n, item: n + item["chars"])
    return rows.select(
        "page_id", F.size("sequence").cast("long").alias("n_items"), F.size(texts).cast("long").alias("n_texts"),
        (F.size("sequence") - F.size(texts)).cast("long").alias("n_media"), chars.alias("n_chars"), "sequence",
    )
