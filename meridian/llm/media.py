"""Media columns: interleaved sequences of text and media.

HTML is parsed to an ordered array of items, each a run of text or a reference to media with its caption and digest. A join on the digest
resolves each reference to the stored payload or to what was computed from it; position and caption stay with the item.
"""

from __future__ import annotations

import re
import struct
import zlib
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import free, small_batches, tidy

ITEM = "struct<pos:int,kind:string,text:string,digest:string,caption:string>"
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "blockquote", "pre", "title"}
_HIDDEN = {"script", "style", "noscript", "template"}
_MEDIA = {"img", "audio", "video", "source", "embed"}


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure = 0  # items before the open figure

    def flush(self):
        if text := re.sub(r"\s+", " ", "".join(self.words)).strip():
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)
        if tag in _MEDIA:
            a = dict(attrs)
            digest = a.get("data-digest") or (a.get("src") or "").removeprefix("sha256:")
            if digest:
                self.flush()
                self.items.append({"kind": "media", "text": None, "digest": digest, "caption": a.get("alt") or None})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            for x in self.items[self.figure :]:
                if x["kind"] == "media" and said:
                    x["caption"] = said
            self.caption = None
        elif tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """Items of one page in order; an empty list for an empty page and for a null one. Scripts and styles are left out."""
    p = _Items()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": i, **x} for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, html: str = "html", items: str = "items") -> DataFrame:
    """pages with an array of items instead of its html: empty for a null or empty page. Rows and other columns stay; a column named like the new one is
    replaced. An empty table stays empty.
    """
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c.lower() not in (html.lower(), items.lower())]

    @F.pandas_udf(f"array<{ITEM}>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(parse, na_action=None)

    return pages.select(*rest, run(F.col(html)).alias(items))


def resolve(pages: DataFrame, media: DataFrame, items: str = "items", digest: str = "digest") -> DataFrame:
    """A row for each media item of each page: the page's other columns, pos, caption, digest, then media's other columns (null if unknown).

    media has one row for each digest at most; rows without a digest are never found. A null or empty array of items gives no row, and a null item is passed
    over. Columns of the page that are named pos, caption or digest get the prefix `page_`; columns of media that clash with any of those get the
    prefix `media_`. Rows of pages that repeat give repeated rows. Both sides are dealt by digest; a digest that very many pages share makes a large partition of
    references (not of payloads), which adaptive execution splits. With an empty side: no rows, or nulls for all that media would give.
    """
    own = [c for c in pages.columns if c != items]
    kept = [F.col(f"`{c}`").alias(f"page_{c}" if c.lower() in ("pos", "caption", "digest") else c) for c in own]
    item = free(pages, "own_item")
    refs = pages.select(*kept, F.explode(F.filter(F.col(f"`{items}`"), lambda x: x["kind"] == "media")).alias(item)).select("*", *[F.col(f"`{item}`.{c}").alias(c) for c in ("pos", "caption", "digest")]).drop(item)
    taken = {c.lower() for c in refs.columns}
    key = free(refs, free(media, "own_key"))
    other = media.select(F.col(digest).alias(key), *[F.col(f"`{c}`").alias(f"media_{c}" if c.lower() in taken else c) for c in media.columns if c != digest])
    return refs.join(other, refs["digest"] == other[key], "left").drop(key)


# --- payloads: texts as lossless 8-bit grey pictures

WIDTH = 192
#: Bytes of a payload in one picture, at most; a multiple of WIDTH. A longer payload is several pictures with text between them.
PART = 40 * WIDTH
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, positions array<int>, captions array<string>"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def stored(samples: bytes) -> bytes:
    """A grey picture (portable network graphics, 8 bits a sample, WIDTH samples a row, no filter) of a positive multiple of WIDTH bytes."""
    n = len(samples) // WIDTH
    rows = np.zeros((n, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(n, WIDTH)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, n, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_back(form: bytes) -> bytes:
    """The samples of a stored picture; an error if it is none or was changed."""
    if form[:8] != _SIGNATURE:
        raise ValueError("no picture")
    at, size, data = 8, None, []
    while at < len(form):
        (n,) = struct.unpack_from(">I", form, at)
        kind, body = form[at + 4 : at + 8], form[at + 8 : at + 8 + n]
        if len(form) < at + 12 + n or struct.unpack_from(">I", form, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("the picture is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8 bits of grey")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


class _Reader:
    """Figures of one payload, from its pictures in order."""

    def __init__(self):
        self.payload, self.media, self.n, self.media_n, self.tail = sha256(), sha256(), 0, 0, b""
        self.hist, self.total, self.square = np.zeros(8, np.int64), 0, 0

    def add(self, form: bytes) -> None:
        samples = read_back(form)
        self.payload.update(samples)
        self.media.update(form)
        self.n += len(samples)
        self.media_n += len(form)
        self.tail = (self.tail + samples[-16:])[-16:]
        count = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
        value = np.arange(256)
        self.hist += count.reshape(8, 32).sum(1)
        self.total += int(count @ value)
        self.square += int(count @ (value * value))

    def feature(self) -> str:
        """Rows, mean, deviation and a histogram of 8 bins of the samples."""
        mean = self.total / self.n
        return f"{self.n // WIDTH}x{WIDTH};mean={mean:.4f};dev={max(self.square / self.n - mean * mean, 0) ** 0.5:.4f};hist={'/'.join(map(str, self.hist))}"

    def figures(self) -> tuple:
        return self.n, self.payload.hexdigest(), zlib.crc32(self.tail), self.media_n, self.media.hexdigest(), self.feature()


def payload_of(text) -> F.Column:
    """UTF-8 bytes of a text (null: empty), filled with spaces to a positive multiple of WIDTH bytes."""
    t = F.coalesce(text, F.lit(""))
    n = F.octet_length(t)
    fill = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH))).cast("int")
    return F.encode(F.concat(t, F.repeat(F.lit(" "), fill)), "UTF-8")


def parts_of(payload) -> F.Column:
    """A payload in parts of PART bytes, the last one what is left."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(payload) - 1) / PART).cast("int")), lambda i: F.substring(payload, i * PART + 1, F.lit(PART)))


def page_of(payload) -> F.Column:
    """An HTML page of a payload: a figure for each part, referred to by its digest and captioned, with a paragraph between figures."""
    parts = parts_of(payload)
    n = F.size(parts).cast("string")
    figure = lambda x, i: F.concat(F.lit('<figure><img src="sha256:'), F.sha2(x, 256), F.lit('"><figcaption>part '), (i + 1).cast("string"), F.lit(" of "), n, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), F.array_join(F.transform(parts, figure), "<p>to be continued</p>"), F.lit("</article>"))


def store(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Columns digest (of a part's bytes) and media (its picture): one row for each different part of all payloads. A null payload has no parts."""
    small_batches(payloads.sparkSession)
    part = payloads.filter(F.col(payload).isNotNull()).select(F.explode(parts_of(F.col(payload))).alias("part"))

    def run(batches):
        for b in batches:
            digest, media, seen = [], [], set()
            for x in b.column("part").to_pylist():
                if (d := sha256(x).hexdigest()) not in seen:  # copies within a batch once
                    seen.add(d)
                    digest.append(d)
                    media.append(stored(x))
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return part.mapInArrow(tidy(run), "digest string, media binary").groupBy("digest").agg(F.first("media").alias("media"))


def reassembled(found: DataFrame, key: str, form: str = "media", pictures: str | None = None) -> DataFrame:
    """Columns key and FEATURES: a row for each key of resolve()'s rows, from its pictures in the order of their positions.

    Pictures are read back from their stored bytes one after the other, so a payload of any length takes little memory. media_bytes and media_sha256 are of
    all stored pictures in that order. A key with a picture that was not found has null figures, and so has a null key, under which all
    such rows come together. An empty table stays empty. pictures: a column with the number of pictures of the row's page, where keys are pages; the rows
    of a page with one picture are then read where they lie, and only others are dealt by key.
    """
    from pyspark.sql.types import StructType

    spark = found.sparkSession
    small_batches(spark)
    new = StructType.fromDDL(FEATURES)
    rows = found.select(F.col(key).alias("key"), "pos", "caption", F.col(form).alias("form"), F.lit(0).alias("n") if pictures is None else F.col(pictures).alias("n"))
    deal = lambda d: d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "pos")
    schema = StructType([StructType(rows.schema.fields[:1])["key"], *new])

    def run(batches):
        now, reader, at, said, made = None, None, [], [], []

        def done():
            if at:
                made.append((now, *(reader.figures() if reader else (None,) * 6), list(at), list(said)))

        def flush():
            columns = [pa.array(c, f) for c, f in zip(zip(*made), types, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            for k, pos, caption, x in zip(*(b.column(c).to_pylist() for c in ("key", "pos", "caption", "form")), strict=True):
                if k != now or not at:
                    done()
                    now, reader = k, _Reader() if k is not None else None
                    at.clear()
                    said.clear()
                at.append(pos)
                said.append(caption)
                if x is None:
                    reader = None
                elif reader:
                    reader.add(x)
            if len(made) >= 500:
                yield flush()
        done()
        if made:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    types, names = [f.type for f in arrow], arrow.names
    several = deal(rows if pictures is None else rows.filter("n <> 1 or n is null")).drop("n").mapInArrow(tidy(run), schema)
    if pictures is not None:
        several = rows.filter("n = 1").drop("n").mapInArrow(tidy(run), schema).unionByName(several)
    return several.withColumnRenamed("key", key)
