"""Repeated byte strings over a collection of texts, by column-wise construction in buckets.

Every string of `length` bytes is known by its anchor: of its `GRAM`-byte grams the one with the least hash, the first of equal ones. Equal strings have equal
anchors at equal places, so texts are cut into segments: runs of strings with the same anchor. Segments with the same gram make a bucket.
Equal segments are counted as one; a segment that occurs twice is repeated as a whole.

Different segments of one bucket, aligned at their anchors, are a small collection of documents. It is built column by column from the right, one
symbol for each segment a round: the order of all suffixes (the transform's round of that column) and the common prefixes of neighbours are read from
first to last and written anew by a stable sort of the symbols, as sequential arrays of bounded size. A string is repeated where its suffix
shares `length` symbols with a neighbour. Suffixes of other rounds cannot be equal strings, as their anchors lie elsewhere; they stay out of a round.

A bucket of over BUCKET different segments is split by blocks of strings and the bytes that all strings of a block have, at last by whole
strings, which are only counted. So no group grows with the input and nothing is left out.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import durable, groups, scratch, small_batches, tidy, utf8

GRAM = 32
BUCKET = 16_000
#: Bytes of texts whose hashes are held at once; a longer text goes in overlapping parts. Under 2 ** 24, a place's bits in a key.
PIECE = 1 << 18
#: Segments whose columns are held at once.
TOGETHER = 16_000
#: Strings in a block, level by level, of buckets that are too large.
BLOCKS = (32, 1)
_PLACE = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(400)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
#: h: hash of the anchor's gram, seg: of the segment's bytes, k1 and k2: of the text; place: see place_of.
SEGMENT = "h long, seg long, k1 long, k2 long, place long"


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h, span = _BYTE[data], 1
    while span < GRAM:
        h = h[:-span] * _FACTOR[span.bit_length()] + h[span:]
        h ^= h >> np.uint64(31)
        span *= 2
    h *= _FACTOR[0]
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts that lie one after the other: each segment's first string, number of strings, anchor's place and hash, all as places in data."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = _grams(data)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(data) - length + 1
    low = np.minimum(low[:n], low[width - span : width - span + n])
    anchor = (low & _PLACE).astype(np.int64)
    change = np.zeros(n + 1, np.int32)
    size = np.diff(at)
    long = size >= length
    change[at[:-1][long]] += 1
    np.add.at(change, at[:-1][long] + size[long] - length + 1, -1)
    inside = np.cumsum(change)[:n] > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    first[at[:-1][long]] = True
    begin = np.flatnonzero(first)
    if not len(begin):
        return none, none, none, np.zeros(0, np.uint64)
    number = np.add.reduceat(inside.astype(np.int64), begin)
    return begin, number, anchor[begin], h[anchor[begin]]


def place_of(start, n, off, weight):
    """First byte of a segment, its number of strings, the anchor's distance and how often it occurs (1, or 2 for more), in one number.

    3 stands for a segment that its own text has before, in a row with 2: known to be repeated, it needs no comparing.
    """
    return (start << 30) | (n << 16) | (off << 2) | weight


def _parts_of(place: np.ndarray):
    return place >> 30, (place >> 16) & 16383, (place >> 2) & 16383, place & 3


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    both = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _segments(length: int):
    def of(column):
        """Rows of SEGMENT for all texts of a column."""
        data, at = utf8(column)
        k1, k2 = _keys(data, at)
        parts = []
        for a, b in groups(at, PIECE):
            if at[b] - at[a] <= PIECE:
                parts.append((a, at[a], at[a : b + 1] - at[a], data[at[a] : at[b]]))
            else:  # one long text: strings that begin in a part are whole in it
                for i in range(int(at[a]), int(at[b]), PIECE - length):
                    end = min(i + PIECE - 1, int(at[b]))
                    if end - i >= length:
                        parts.append((a, i, np.array([0, end - i]), data[i:end]))
        for a, base, own, piece in parts:
            begin, number, anchor, h = anchors(piece, own, length)
            if not len(begin):
                continue
            doc = np.searchsorted(own, begin, "right") - 1 + a
            raw = piece.tobytes()
            seg = [xxhash.xxh3_64_intdigest(raw[i : i + n - 1 + length]) for i, n in zip(begin.tolist(), number.tolist(), strict=True)]
            seg = np.array(seg, np.uint64)
            order = np.lexsort((begin, seg, h, doc))
            again = np.append(False, (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1]) & (seg[order][1:] == seg[order][:-1]))
            weight = np.ones(len(begin), np.int64)
            weight[order[np.flatnonzero(again[1:] & ~again[:-1])]] = 2
            weight[order[again]] = 3
            place = place_of(begin + base - at[doc], number, anchor - begin, weight)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(k1[doc]), pa.array(k2[doc]), pa.array(place)], names=["h", "seg", "k1", "k2", "place"])

    return lambda batches: (made for b in batches for made in of(b.column(0)))


def _compressed(others: list[str]):
    """Texts as zstandard frames with their keys: a third of the bytes to deal."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            data, at = utf8(b.column("text"))
            k1, k2 = _keys(data, at)
            z = [pack(data[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.array(k1), pa.array(k2), pa.array(z, pa.binary())], names=[*others, "k1", "k2", "z"])

    return run


def compressed(docs: DataFrame) -> DataFrame:
    """docs (column text and others) with k1, k2, z instead of text."""
    from pyspark.sql.types import StructType

    others = [c for c in docs.columns if c != "text"]
    return docs.mapInArrow(tidy(_compressed(others)), StructType([*docs.select(*others).schema, *StructType.fromDDL("k1 long, k2 long, z binary")]))


def columnwise(group: np.ndarray, bodies: list[bytes], off: np.ndarray, number: np.ndarray, length: int) -> np.ndarray:
    """Which strings of segments are repeated in their group: a row for each segment, a column for each string, counted from its last anchor place.

    group: ascending numbers. Column c of the collection is the byte at c from the anchor. Order and common prefixes of the suffixes that begin
    in the column are made from those of the column to the right.
    """
    width = length - GRAM + 1
    m = len(bodies)
    lo = -off
    size = np.array([len(b) for b in bodies])
    end = lo + size
    left = width - 1  # columns from -left to length - 1
    table = np.zeros((left + length, m), np.uint8)
    for i in range(0, m, 500):  # few at a time: the index takes eight times the bytes
        part = size[i : i + 500]
        flat = np.frombuffer(b"".join(bodies[i : i + 500]), np.uint8)
        shift = lo[i : i + 500] + left - (np.cumsum(part) - part)
        table[np.arange(len(flat)) + np.repeat(shift, part), np.repeat(np.arange(i, i + len(part)), part)] = flat
    found = np.zeros((left + 1, m), bool)
    by_end = np.argsort(-end, kind="stable")
    ends = -end[by_end]
    entered = 0
    order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int32)  # prefix[i]: common to order[i - 1] and order[i]
    first_lo = lo.min()
    for c in range(length - 1, int(first_lo) - 1, -1):
        upto = int(np.searchsorted(ends, -(c + 1), "right"))
        if upto > entered:  # suffixes that begin here are empty so far: before all others
            order = np.concatenate([by_end[entered:upto], order])
            prefix = np.concatenate([np.zeros(upto - entered, np.int32), prefix])
            if upto - entered < len(prefix):
                prefix[upto - entered] = 0
            entered = upto
        if c < 0:
            stay = lo[order] <= c
            if not stay.all():  # a suffix that leaves hands its common prefix on
                kept = np.flatnonzero(stay)
                if not len(kept):
                    order, prefix = order[:0], prefix[:0]
                    continue
                prefix = np.minimum.reduceat(prefix[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
                order = order[kept]
        if len(order) < 2:
            prefix = np.zeros(len(order), np.int32)
            continue
        label = (group[order] << 8) | table[c + left, order]
        old = np.argsort(label, kind="stable")
        label, order = label[old], order[old]
        new = np.zeros(len(order), np.int32)
        same = np.flatnonzero(label[1:] == label[:-1]) + 1
        if len(same):
            p, q = old[same - 1] + 1, old[same] + 1
            new[same] = np.minimum.reduceat(np.append(prefix, 0), np.stack([p, q], 1).reshape(-1))[::2] + 1
        prefix = new
        if c <= 0:
            long = prefix >= length
            long[:-1] |= long[1:]
            found[c + left, order[long]] = True
    return found


def _bodies(length: int, block: int | None):
    """From rows of a text and its wanted segments: their bytes, or with a block, their parts as new segments."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            want = b.column("want")
            n_of = np.diff(want.offsets.to_numpy())
            flat = want.flatten()
            h, seg, place = (flat.field(f).to_numpy() for f in ("h", "seg", "place"))
            start, n, off, weight = _parts_of(place)
            k1, k2 = (np.repeat(b.column(k).to_numpy(), n_of) for k in ("k1", "k2"))
            i = 0
            for z, m in zip(b.column("z"), n_of.tolist(), strict=True):
                raw = unpack(z.as_py())
                own = slice(i, i + m)
                i += m
                if block is None:
                    body = [raw[x : x + y - 1 + length] for x, y in zip(start[own].tolist(), n[own].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (h, seg, k1, k2, place)] + [pa.array(body, pa.binary())], names=["h", "seg", "k1", "k2", "place", "body"])
                    continue
                out = ([], [], [], [])
                for j in range(own.start, own.stop):
                    first = -int(off[j])  # place of its first string from the anchor
                    last, at = first + int(n[j]) - 1, int(start[j])
                    for k in range(first // block, last // block + 1):
                        x, y = max(first, k * block), min(last, k * block + block - 1)
                        core = at + k * block - first  # from here, block - 1 bytes on, all strings of the block agree or none
                        out[0].append(xxhash.xxh3_64_intdigest(raw[core + block - 1 : core + length], int(h[j] + k) & (2**64 - 1)))
                        out[1].append(xxhash.xxh3_64_intdigest(raw[at + x - first : at + y - first + length]))
                        out[2].append(place_of(at + x - first, y - x + 1, -x, int(weight[j])))
                        out[3].append(j)
                who = np.array(out[3])
                yield pa.RecordBatch.from_arrays([_signed(out[0]), _signed(out[1]), pa.array(k1[who]), pa.array(k2[who]), pa.array(out[2], pa.int64())], names=["h", "seg", "k1", "k2", "place"])

    return run


SPAN = "k1 long, k2 long, begin long, end long"


def _runs(length: int):
    """Spans of repeated strings in segments that come sorted by bucket."""

    def of(table: pa.Table):
        h, k1, k2, place = (table.column(c).to_numpy() for c in ("h", "k1", "k2", "place"))
        start, n, off, weight = _parts_of(place)
        group = np.cumsum(np.append(0, h[1:] != h[:-1]))
        found = columnwise(group, table.column("body").to_pylist(), off, n, length)
        found[:, weight > 1] = False  # repeated as a whole, which is known
        edge = np.diff(np.concatenate([np.zeros((1, len(h)), np.int8), found.view(np.int8), np.zeros((1, len(h)), np.int8)]), axis=0).T
        row, a = np.nonzero(edge == 1)
        z = np.nonzero(edge == -1)[1]
        base = (start + off)[row] - (length - GRAM)
        return pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(base + a), pa.array(base + z - 1 + length)], names=["k1", "k2", "begin", "end"])

    def run(batches):
        held, rows, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column("h").to_numpy()
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)] if last is None or h[0] == last else [0, 0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            done = 0
            for c in cuts[1:-1]:  # a bucket ends before row c
                if rows + c - done >= TOGETHER:
                    held.append(b.slice(done, c - done))
                    yield of(pa.Table.from_batches(held))
                    held, rows, done = [], 0, c
            held.append(b.slice(done))
            rows += len(h) - done
            last = h[-1]
        if rows:
            yield of(pa.Table.from_batches(held))

    return run


def repeated_spans(texts: DataFrame, length: int = 400, bucket: int = BUCKET) -> DataFrame:
    """Columns of SPAN: bytes of texts (column text) covered by strings of `length` bytes that also start elsewhere. Spans may overlap."""
    spark = texts.sparkSession
    small_batches(spark)
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    z = compressed(texts)
    once = z.groupBy("k1", "k2").agg(F.first("z").alias("z"))  # in each partition first, so many copies are no large group
    every = durable(texts.mapInArrow(tidy(_segments(length)), SEGMENT), "segments")
    # joins by h go by another number for it: an aggregate's own dealing is then not taken over, so both sides are dealt anew and Spark can split a bucket with very many rows
    g = F.expr("h ^ 1").alias("g")
    known, other = every.filter("place & 3 = 3"), every.filter("place & 3 < 3")
    twice = other.groupBy("h").agg(F.sum(F.expr("place & 3")).alias("c")).filter("c > 1").select(g)
    rows = durable(other.select("*", g).join(twice, "g", "left_semi").drop("g"), "segments-shared")
    span = lambda d: d.selectExpr("k1", "k2", "shiftright(place, 30) as begin", f"shiftright(place, 30) + (shiftright(place, 16) & 16383) - 1 + {length} as end")
    spans = [span(known)]
    for level in range(len(BLOCKS) + 1):
        # any one row stands for equal segments; first() takes all its columns from the same row
        segs = durable(rows.groupBy("h", "seg").agg(F.sum(F.expr("place & 3")).alias("weight"), *[F.first(c).alias(c) for c in ("k1", "k2", "place")]), "segments-distinct")
        whole = rows.join(segs.filter("weight > 1").select("h", "seg"), ["h", "seg"], "left_semi")
        spans.append(span(whole))
        if level == len(BLOCKS):
            break  # whole strings: different ones in a bucket are not equal
        many = segs.groupBy("h").agg(F.count("*").alias("m"), F.min("weight").alias("least")).filter("m > 1 and least = 1")
        several = lambda b: segs.select("*", g).join(b.select(g), "g").selectExpr("h", "seg", "k1", "k2", "place - (place & 3) + least(weight, 2) as place")  # noqa: B023, E731
        want = lambda d: once.join(d.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "seg", "place")).alias("want")), ["k1", "k2"])
        body = want(several(many.filter(F.col("m") <= bucket))).mapInArrow(tidy(_bodies(length, None)), SEGMENT + ", body binary")
        spans.append(body.repartition(dealt, "h").sortWithinPartitions("h").mapInArrow(tidy(_runs(length)), SPAN))
        large = many.filter(F.col("m") > bucket)
        if large.isEmpty():
            break
        rows = durable(want(several(large)).mapInArrow(tidy(_bodies(length, BLOCKS[level])), SEGMENT), "segments-split")
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def cut(docs: DataFrame, text: str = "text", length: int = 400, bucket: int = BUCKET, digests: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept: each whole text without the bytes that a string of `length` bytes covers which also starts elsewhere.

    Texts are UTF-8 bytes, a null one empty; strings never cross texts; all strings are judged on the texts as they come, so every copy goes, and
    texts that occur twice (rows that repeat too) lose all strings of that length. Instead of the text: kept, the remaining bytes as text, of which an
    incomplete character at a cut is left out; with digests kept_sha256, of the remaining bytes themselves. Columns of the new names are replaced. length: 64 to
    16000.
    """
    if not 2 * GRAM <= length <= 16000:
        raise ValueError(f"length is from {2 * GRAM} to 16000")
    new = {"n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"}
    others = [c for c in docs.columns if c.lower() not in new and c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    with scratch(docs.sparkSession):
        spans = repeated_spans(docs.select(whole.alias("text")).filter(F.octet_length("text") >= length), length, bucket)
        per_text = durable(spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans", keep=True)
    packed = compressed(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], whole.alias("text")))
    # never a broadcast: with an exchange in between, a task needs one Python worker at a time
    joined = packed.hint("merge").join(per_text, ["k1", "k2"], "left").select(*[f"c{i}" for i in range(len(others))], "z", "spans")
    name = "kept_sha256" if digests else "kept"

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = b.column("z")
            spans = b.column("spans")
            edges = spans.offsets.to_numpy()
            begin, end = (spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("begin", "end"))
            null = spans.is_null().to_numpy(zero_copy_only=False)
            out = ([], [], [], [])
            for i in range(b.num_rows):
                kept = unpack(texts[i].as_py())
                raw = np.frombuffer(kept, np.uint8)
                removed = runs = 0
                if not null[i]:
                    x, y = begin[edges[i] : edges[i + 1]], end[edges[i] : edges[i + 1]]
                    order = np.argsort(x, kind="stable")
                    x, y = x[order], np.maximum.accumulate(y[order])
                    new_run = np.append(True, x[1:] > y[:-1])
                    x, y = x[new_run], y[np.append(new_run[1:], True)]
                    removed, runs = int((y - x).sum()), len(x)
                    edge = np.zeros(len(raw) + 1, np.int32)
                    edge[x] += 1
                    edge[y] -= 1
                    kept = raw[np.cumsum(edge[:-1]) == 0].tobytes()
                out[0].append(len(raw))
                out[1].append(removed)
                out[2].append(runs)
                out[3].append(sha256(kept).hexdigest() if digests else kept.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*[b.column(f"c{i}") for i in range(len(others))], *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())], names=[*[f"c{i}" for i in range(len(others))], "n_bytes", "n_removed", "n_spans", name])

    from pyspark.sql.types import StructType

    made = joined.mapInArrow(tidy(run), StructType([*joined.select(*[f"c{i}" for i in range(len(others))]).schema, *StructType.fromDDL(f"n_bytes long, n_removed long, n_spans long, {name} string")]))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "n_bytes", "n_removed", "n_spans", name)
