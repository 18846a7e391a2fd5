"""Phrases whose words keep together: level-wise counts of frequent phrases, and scores of their cuts.

Level k counts phrases of k words, but only where both phrases of k-1 words inside are frequent (Apriori). What tasks know of the level before is a bit table of
its frequent phrases' hashes: a broadcast of constant size, however many there are. A hash that two phrases share only lets a phrase be counted that then
proves rare; counts are of the phrases themselves. The tables of all levels give the parts of every cut, by joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import durable, groups, scratch, small_batches, tidy, utf8

#: Words of the longest phrase, and what a frequent phrase occurs at least.
MOST_WORDS, LEAST = 5, 100
#: Bits of the table of frequent hashes (16 MB), and of a part of it that one group makes.
TABLE_BITS, PART_BITS = 27, 15
#: Bytes of texts that are counted together before counts go to Spark.
COUNT_BYTES = 8_000_000
#: Parts that each language's best phrases are first sought in.
PARTS = 32

#: Kinds of bytes: 0 of a word, 1 white space between words, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words but the last, and that of the last."""
    h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (w >> np.uint64(1))


def _hashes(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))


class Words:
    """The words of some texts: code, language's code, and which piece each stands in."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: pa.Array):
        data = _LOWER[data]
        kind = _KIND[data]
        word = kind == 0
        begins = np.flatnonzero(np.diff(at))  # texts that are not empty
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        starts[at[begins]] |= word[at[begins]]
        first = np.flatnonzero(starts)
        lengths = np.diff(np.append(np.cumsum(word)[first] - 1, int(word.sum())))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        held = data[word]
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        self.code, self.words = values.indices.to_numpy().astype(np.int64), values.dictionary
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary
        text = np.searchsorted(at, first, "right") - 1
        self.lang = langs.indices.to_numpy().astype(np.int64)[text]
        ends = kind == 2
        self.piece = np.cumsum(ends)[first] + text if len(first) else text  # both only grow, so the sum is equal where both are

    def phrases(self, k: int, table: np.ndarray | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, phrase and count of all phrases of k words, whose k-1 first and last words the table knows."""
        n = len(self.code) - k + 1
        if n <= 0:
            return self.langs.slice(0, 0), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if k > 1 else np.arange(n)
        if k > 1:
            h1 = _hashes(self.words.to_pylist())[self.code]
            h = _mix(_hashes(self.langs.cast(pa.large_binary()).to_pylist())[self.lang], h1)
            for j in range(1, k - 1):
                h = _mix(h[:-1], h1[j:])
            h >>= np.uint64(64 - (len(table) * 8).bit_length() + 1)
            known = (table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
            at = at[(known[at] & known[at + 1]).astype(bool)]
        many = len(self.words) + 1
        key, bound = self.lang[at], len(self.langs) + 1
        for j in range(k):
            if bound > (1 << 62) // many:  # number the phrases so far: exact, whatever their words
                values, key = np.unique(key, return_inverse=True)
                bound = len(values) + 1
            key, bound = key * many + self.code[at + j], bound * many
        _, one, count = np.unique(key, return_index=True, return_counts=True)
        one = at[one]
        parts = [self.words.take(pa.array(self.code[one + j])) for j in range(k)]
        return self.langs.take(pa.array(self.lang[one])), pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0], count


def _counts(docs: DataFrame, k: int, shared=None) -> DataFrame:
    """Columns lang, phrase, n: partial counts, one row for each phrase of a batch; at k = 1 also rows without a phrase, which count all words."""

    def run(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            langs = b.column("lang")
            for lo, hi in groups(at, COUNT_BYTES):
                w = Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], langs.slice(lo, hi - lo))
                lang, phrase, n = w.phrases(k, shared and shared.value)
                lang, phrase = lang.cast(pa.string()), phrase.cast(pa.large_string())
                if k == 1:
                    total = np.bincount(w.lang, minlength=len(w.langs))
                    lang, phrase, n = pa.concat_arrays([lang, w.langs.cast(pa.string())]), pa.concat_arrays([phrase, pa.nulls(len(total), pa.large_string())]), np.concatenate([n, total])
                for s in range(0, len(n), 100_000):
                    yield pa.RecordBatch.from_arrays([lang.slice(s, 100_000), phrase.slice(s, 100_000).cast(pa.string()), pa.array(n[s : s + 100_000])], names=["lang", "phrase", "n"])

    return docs.mapInArrow(tidy(run), "lang string, phrase string, n long")


def _table(frequent: DataFrame, size: int) -> np.ndarray:
    """2 ** size bits for the hashes of frequent phrases, made in parts by executors."""
    own_bits = min(PART_BITS, size)

    def places(batches):
        for b in batches:
            langs, phrases = b.column("lang").to_pylist(), b.column("phrase").to_pylist()
            words = [p.encode().split(b" ") for p in phrases]
            h = _hashes([x.encode() for x in langs])
            for j in range(max(map(len, words), default=0)):
                there = np.array([i for i, x in enumerate(words) if len(x) > j], np.int64)
                h[there] = _mix(h[there], _hashes([words[i][j] for i in there]))
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - size)).astype(np.int64))], names=["place"])

    def bits(key, t):
        own = np.zeros(1 << own_bits, np.uint8)
        own[t.column("place").to_numpy() & ((1 << own_bits) - 1)] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    found = frequent.select("lang", "phrase").mapInArrow(places, "place long").distinct()
    parts = found.withColumn("part", F.shiftright("place", own_bits)).groupBy("part").applyInArrow(bits, "part long, bits binary").toArrow()
    out = np.zeros(1 << (size - 3), np.uint8)
    for part, b in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        out[part << (own_bits - 3) : (part + 1) << (own_bits - 3)] = np.frombuffer(b, np.uint8)
    return out


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_WORDS, least: int = LEAST, table_bits: int = TABLE_BITS) -> tuple[DataFrame, DataFrame]:
    """Written tables: lang, phrase, k, n of all phrases of up to `most` words that occur `least` times or more; and lang, n of all words.

    Texts are lower-cased in A-Z and split to pieces and words; a null text is empty and a null lang is `und`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("octet_length(text) > 0")
    ones = durable(_counts(docs, 1).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    found = [ones.filter("phrase is not null")]
    for k in range(2, most + 1):
        shared = spark.sparkContext.broadcast(_table(found[-1], table_bits))
        found.append(durable(_counts(docs, k, shared).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), f"phrases-{k}"))
        shared.unpersist()
    every = [t.select("lang", "phrase", F.lit(k).alias("k"), "n") for k, t in enumerate(found, 1)]
    out = every[0]
    for t in every[1:]:
        out = out.unionByName(t)
    return out, ones.filter("phrase is null").select("lang", "n")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_WORDS, least: int = LEAST, best: int | None = None, table_bits: int = TABLE_BITS) -> DataFrame:
    """Columns lang, phrase, k, cut, a, l, r, n, score of phrases of 2 to `most` words that occur `least` times or more; with best, the first so many of each lang, and their rank.

    Score of a cut: floor(1000 * a * n / (l * r)), exact; the lowest counts, then the earliest cut. Phrases whose words stand in a longer candidate that occurs as often are
    left out. Order: score and a descending, phrase ascending by its bytes. A null text is empty, a null lang is `und`; equal rows count each; no phrase spans two texts or
    pieces. An empty table gives no rows; other columns are not read, whatever their names.
    table_bits (3 and up): the size of what is broadcast; a fuller table lets more phrases be counted in vain, no more.
    """
    with scratch(docs.sparkSession):
        counted, totals = levels(docs, text, lang, most, least, table_bits)
        made = durable(_scored(counted, totals), "collocations", keep=True)
    if best is None:
        return made
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))  # the best of each part first: no task sees a whole language
    first = made.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best).drop("part", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)


def _scored(counted: DataFrame, totals: DataFrame) -> DataFrame:
    wide = counted.filter("k > 1").withColumnRenamed("n", "a")
    words = F.split("phrase", " ", -1)
    # A longer candidate that occurs as often has one of just one word more inside it that holds the phrase and occurs as often, too.
    inner = wide.filter("k > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = wide.join(inner.hint("merge"), ["lang", "phrase"], "left").filter("longer is null or longer < a").drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ")).withColumn("rest", F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " "))
    part = lambda name, n: counted.select("lang", F.col("phrase").alias(name), F.col("n").alias(n)).hint("merge")
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))  # a language may have a third of all phrases
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int")).join(salted.hint("merge"), ["lang", "salt"])
    score = F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("v"))
    return lowest.select("lang", "phrase", "k", "v.cut", "a", "v.l", "v.r", "n", "v.score")



