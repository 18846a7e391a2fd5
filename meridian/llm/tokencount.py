"""Token counts of whole texts, huge ones too, by overlapping chunks that are put together again.

A text of ordinary length is counted at once. A huge one is cut into chunks that overlap; Spark deals the chunks, each is encoded with the offsets of its tokens,
and neighbours are spliced in their overlap after a token that both have at the same place. Texts whose chunks have no such token are cut anew into larger chunks
with wider overlaps, at last into one, so every count is exact.

Why a token that both have is a safe place. Chunks are cut only before characters that no normalisation joins with what stands before them, so a chunk's normalised
text is a piece of the whole text's. The words that the left chunk finds begin where the whole text's do (a word's beginning depends on what stands before, and
the left chunk's overlap ends a special token's length before any word that its end could change); those of the right chunk end where the whole text's do. Inside
a word, merges are ranked and a merge's parts come from earlier merges, so a sequence of tokens is the word's encoding if and only if each two neighbours are the encoding
of their own text. Tokens up to the shared one come from the left chunk, those after it from the right one, and each two neighbours are neighbours in one of them.
`open()` checks the ranks of the merges; where they are not so, only the first token of a word that both begin at the same place is taken.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import durable, free, map_texts, small_batches, tidy

#: Characters of a chunk of a huge text, and how far neighbours overlap; a text longer than a chunk is huge.
CHUNK, OVERLAP = 32_768, 512
#: Words that a task remembers with their counts, none longer than WORD_CHARS.
REMEMBERED, WORD_CHARS = 500_000, 64
#: What the tokenizer file has to say for words to be counted one by one.
NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def joining() -> frozenset[str]:
    """Characters that a normalisation may join with, or move before, what stands before them."""
    second = {chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))} | {chr(c) for c in (*range(0x1160, 0x1200), *range(0xD7B0, 0xD800))}
    for c in range(0xA0, 0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            second.add(chr(int(parts[1], 16)))
    return frozenset(second)


def cut_before(text: str, at: int) -> int:
    """The last place up to at where a text can be cut."""
    if 0 < at < len(text) and text[at] >= "̀":
        joins = joining()
        while 0 < at and text[at] >= "̀" and text[at] in joins:
            at -= 1
    return max(0, min(at, len(text)))


class Counter:
    """A tokenizer file. Pickles as its content, so executors need no file."""

    def __init__(self, content: str):
        self.content, self._ready = content, False

    @classmethod
    def load(cls, path: str) -> Counter:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def __reduce__(self):
        return Counter, (self.content,)

    def open(self) -> Counter:
        if self._ready:
            return self
        from tokenizers import Tokenizer

        spec = json.loads(self.content)
        self.tokenizer = Tokenizer.from_str(self.content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        norm = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = [(n.get("type"), (n.get("pattern") or {}).get("Regex")) for n in norm] == NORMALIZERS and norm[1]["content"] == " "
        known = known and [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": SPLIT} and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
        known = known and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        model = spec["model"]
        self.by_words = known and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
        self.ranked = model["type"] == "BPE" and not model.get("dropout") and _ranked(model["merges"])
        self.find = regex.compile(SPLIT.replace(r"\s", r"\p{White_Space}")).findall
        self.model = self.tokenizer.model
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet: printable bytes stand for themselves
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.counts: dict[str, int] = {}
        self._ready = True
        return self

    def forget(self) -> None:
        if self._ready:
            self.counts.clear()

    def count(self, text: str, plain: bool) -> int:
        """Tokens of a whole text; plain: all its characters are below U+0240, where normal forms are the characters themselves."""
        if not plain or not self.by_words or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        counts, n = self.counts, 0
        words = self.find(text.lower())
        try:
            return sum(map(counts.__getitem__, words))
        except KeyError:
            pass
        if len(counts) > REMEMBERED:
            counts.clear()
        for w in words:
            c = counts.get(w)
            if c is None:
                c = len(self.model.tokenize(w.encode().decode("latin-1").translate(self.alphabet)))
                if len(w) <= WORD_CHARS:
                    counts[w] = c
            n += c
        return n


def _ranked(merges: list) -> bool:
    """Whether the parts of each merge are single symbols or come from earlier merges, and no two merges make the same."""
    made: set[str] = set()
    for m in merges:
        a, b = m if isinstance(m, list) else m.split(" ")
        if any(len(x.removesuffix("</w>")) > 1 and x not in made for x in (a, b)) or a + b in made:
            return False
        made.add(a + b)
    return True


def _edges(c: Counter, chunk: str, offset: int, left: int, right: int) -> tuple[int, bytes, bytes]:
    """Number of tokens of a chunk, and its last tokens of places (begin, end, id, number, first of its word) in the overlaps before left and after right."""
    e = c.tokenizer.encode(chunk, add_special_tokens=False)
    if not len(e.ids):
        return 0, b"", b""
    at = np.array(e.offsets, np.int64).reshape(-1, 2) + offset
    ids, words = np.array(e.ids, np.int64), np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    last = np.append(at[1:, 0] >= at[:-1, 1], True)  # of several tokens at one character, the last
    first = np.append(True, words[1:] != words[:-1])
    rows = np.stack([at[:, 0], at[:, 1], ids, np.arange(len(ids)), first], 1)
    head = rows[last & (at[:, 1] <= left)]
    tail = rows[last & (at[:, 0] >= right) & (np.arange(len(ids)) < len(ids) - 1)]  # the last token may be cut
    return len(ids), head.tobytes(), tail.tobytes()


def splice(tail: bytes, head: bytes, ranked: bool = True) -> tuple[int, int] | None:
    """Tokens of the left chunk, and of the right one, up to and with a token that both have at one place; None if there is no such token."""
    a, b = np.frombuffer(tail, np.int64).reshape(-1, 5), np.frombuffer(head, np.int64).reshape(-1, 5)
    b = {tuple(x[:3].tolist()): (int(x[3]), bool(x[4])) for x in b}
    middle = sorted(a.tolist(), key=lambda x: abs(x[0] - (a[0, 0] + a[-1, 1]) / 2)) if len(a) else []
    for x in middle:
        there = b.get(tuple(x[:3]))
        if there and (ranked or (x[4] and there[1])):
            return (x[3] + 1, there[0] + 1) if ranked else (x[3], there[0])
    return None


def _chunked(texts: DataFrame, counter, size: int, overlap: int) -> DataFrame:
    """key, number, last, offset and text of the overlapping chunks of texts (key, text), each text one time."""

    def cut(batches):
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                many = max(1, -(-len(text) // size))
                for i in range(many):
                    lo, hi = cut_before(text, max(0, i * size - overlap)), cut_before(text, (i + 1) * size) if i < many - 1 else len(text)
                    # the overlaps: what the chunk before, and the chunk after, have too
                    left, right = (cut_before(text, i * size) if i else lo), (cut_before(text, (i + 1) * size - overlap) if i < many - 1 else hi)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([key], [i], [i == many - 1], [lo], [left], [right])] + [pa.array([text[lo:hi]], pa.string())], names=["key", "i", "last", "lo", "left", "right", "text"])

    chunks = texts.mapInArrow(tidy(cut), "key string, i long, last boolean, lo long, left long, right long, text string")
    return chunks.repartition("key", "i").dropDuplicates(["key", "i"])


def _spliced(chunks: DataFrame, counter) -> DataFrame:
    """key, n_tokens, and whether all neighbours could be spliced, of chunked texts."""

    def encode(batches):
        c = counter.value.open()
        for b in batches:
            rows = [_edges(c, t, lo, left, right) for t, lo, left, right in zip(*[b.column(x).to_pylist() for x in ("text", "lo", "left", "right")], strict=True)]
            n, head, tail = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("i"), b.column("last"), pa.array(n, pa.int64()), pa.array(head, pa.binary()), pa.array(tail, pa.binary())], names=["key", "i", "last", "n", "head", "tail"])

    def join(batches):
        ranked = counter.value.open().ranked
        for b in batches:
            found = [splice(t, h, ranked) for t, h in zip(b.column("tail").to_pylist(), b.column("head").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([f is not None for f in found], pa.bool_()), pa.array([f and f[0] - f[1] for f in found], pa.int64()), b.column("n")], names=["key", "ok", "more", "n"])

    made = durable(chunks.mapInArrow(tidy(encode), "key string, i long, last boolean, n long, head binary, tail binary"), "chunks")
    right = made.select("key", (F.col("i") - 1).alias("i"), "head", F.col("n").alias("n_right"))
    pairs = made.filter("not last").select("key", "i", "tail", "n").join(right.hint("merge"), ["key", "i"])
    # tokens up to the splice from the left, those after it from the right: the sum over chunks, less what each splice leaves out
    cuts = pairs.select("key", "tail", "head", "n").mapInArrow(tidy(join), "key string, ok boolean, more long, n long").select("key", "ok", (F.col("more") - F.col("n")).alias("n"))
    every = made.select("key", F.lit(True).alias("ok"), "n").unionByName(cuts)
    return every.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.bool_and("ok").alias("ok"))


def huge_counts(texts: DataFrame, counter: Counter, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """n_tokens of each distinct key of texts (key, text), by overlapping chunks; where some cannot be spliced, by chunks and overlaps four times as large, until all can."""
    if overlap < 64 or chunk < 2 * overlap:
        raise ValueError("an overlap is 64 characters at least, and a chunk two overlaps")
    shared, done, left = texts.sparkSession.sparkContext.broadcast(counter), None, texts
    while True:
        found = durable(_spliced(_chunked(left, shared, chunk, overlap), shared), "counts", keep=True)
        good = found.filter("ok").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = found.filter("not ok").select("key")
        if failed.isEmpty():
            return done
        left, chunk, overlap = texts.join(failed.hint("merge"), "key", "left_semi"), 4 * chunk, 4 * overlap


def count_tokens(docs: DataFrame, counter: Counter, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs without its text column, with n_bytes (UTF-8) and n_tokens of each whole text, as the tokenizer gives them without special tokens added.

    A null or empty text has no bytes and no tokens. Strings of special tokens inside a text count as those tokens. Rows and other columns stay as they are, whatever their
    names, but for columns n_bytes and n_tokens, which are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rest = docs.drop(*[c for c in docs.columns if c.lower() in ("n_bytes", "n_tokens") and c != text])
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    huge = F.coalesce(F.length(F.col(text)) > chunk, F.lit(False))
    shared = spark.sparkContext.broadcast(counter)

    def run(data, at):
        c = shared.value.open()
        raw = memoryview(data)
        high = np.flatnonzero(data >= 0xC9)  # first bytes of U+0240 and above, and none below
        plain = np.diff(np.searchsorted(high, at)) == 0
        return [pa.array(np.diff(at)), pa.array([c.count(str(raw[a:b], "utf-8"), p) for a, b, p in zip(at[:-1].tolist(), at[1:].tolist(), plain.tolist(), strict=True)], pa.int64())]

    own, key = free(rest, "own_text"), free(rest, "own_key")
    small = map_texts(rest.filter(~huge).withColumnRenamed(text, own), own, run, "n_bytes long, n_tokens long", lambda: shared.value.forget())
    large = rest.filter(huge).withColumn(key, F.sha2(F.col(text), 256))
    counts = huge_counts(rest.filter(huge).select(F.sha2(F.col(text), 256).alias("key"), F.col(text).alias("text")), counter, chunk, overlap)
    counts = counts.select(F.col("key").alias(key), "n_tokens")
    large = large.withColumn("n_bytes", size).drop(text).join(counts.hint("merge"), key).drop(key)
    return small.unionByName(large.select(*small.columns))
