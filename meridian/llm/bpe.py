"""Byte-pair encoding by a table of distinct words.

Spark splits all texts to words and counts the distinct ones. The most frequent words, as many as a stated bound lets be broadcast, are
encoded once each for the whole corpus; the id strings and pieces of each text come from that table by the words' positions. A word
outside it, from the long tail of rare ones, is encoded once by each task that meets it and joined in the same way (again, if more of them
than a task remembers lie in between), so nothing is dropped or cut.
Ids go back to bytes through a table from id to piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import durable, free, map_texts, tidy

#: The pattern that splits texts before byte-level merges, white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
JAVA_PATTERN = PATTERN.replace(r"\p{White_Space}", r"\p{IsWhite_Space}").replace(r"\P{White_Space}", r"\P{IsWhite_Space}")
TABLE_WORDS = 150_000
#: Rare words that a task remembers from batch to batch.
REMEMBERED = 50_000
#: A longer word (a run without a break) is not kept in the table.
WORD_CHARS = 64


def _byte_chars() -> dict[str, int]:
    """Byte for each character of the vocabulary's byte alphabet: printable bytes stand for themselves, the others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Codec:
    """A byte-level tokenizer file. Pickles as its content, so executors need no file."""

    def __init__(self, content: str):
        self.content = content
        self._ready = False

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def __reduce__(self):
        return Codec, (self.content,)

    def open(self) -> Codec:
        if not self._ready:
            from tokenizers import Tokenizer

            spec = json.loads(self.content)
            alphabet = _byte_chars()
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            pieces = {str(i): bytes(alphabet[c] for c in w) for w, i in spec["model"]["vocab"].items()} | {str(i): w.encode() for w, i in special.items()}
            self.piece_of = pieces.__getitem__
            self.special = special
            self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
            self.find = regex.compile(PATTERN).findall
            self.model = Tokenizer.from_str(self.content).model
            self.alphabet = {b: ch for ch, b in alphabet.items()}
            self._ready = True
        return self

    def words(self, text: str) -> list[str]:
        if self.split_special is None or not any(s in text for s in self.special):
            return self.find(text)
        return [w for part in self.split_special.split(text) for w in ([part] if part in self.special else self.find(part))]

    def ids(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word by the tokenizer's own merges; a word is one piece of text, so there is nothing to split or normalise any more."""
        merge, alphabet = self.model.tokenize, self.alphabet
        for w in words:
            yield [self.special[w]] if w in self.special else [t.id for t in merge(w.encode().decode("latin-1").translate(alphabet))]

    def entries(self, words: list[str]) -> dict[str, str]:
        """Word to its ids, decimal and joined by commas."""
        return {w: ",".join(map(str, i)) for w, i in zip(words, self.ids(words), strict=True)}

    def decode(self, ids: str) -> str:
        """Text of decimal ids joined by commas; bytes that are no characters are replaced, as the tokenizer does."""
        return b"".join(map(self.piece_of, ids.split(","))).decode("utf-8", "replace") if ids else ""


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns word, n: every distinct word of all texts and how often it occurs."""
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def encoded_words(words: DataFrame, codec: Codec, most: int = TABLE_WORDS) -> pa.Table:
    """Columns word, ids (decimal, joined by commas) of the words for the broadcast table, none longer than WORD_CHARS: all that occur so often, by a
    power of two, that no more than `most` do.

    Executors encode them, each word once; at most `most` rows of bounded length come to the driver.
    """
    words = durable(words.filter(F.length("word") <= WORD_CHARS), "words")
    left, least = most, 1
    for power, n in sorted(((r[0], r[1]) for r in words.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()), reverse=True):
        if n > left:
            least = 1 << (power + 1)
            break
        left -= n

    def run(batches):
        for b in batches:
            w = b.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([",".join(map(str, i)) for i in codec.open().ids(w)], pa.string())], names=["word", "ids"])

    return words.filter(F.col("n") >= least).select("word").mapInArrow(tidy(run), "word string, ids string").toArrow()


#: Columns that encode can make besides n_tokens.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, codec: Codec, text: str = "text", table: pa.Table | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """docs with n_tokens and the named outputs of each whole text (null: empty); ids_sha256 is of the decimal ids joined by commas.

    Equal to the tokenizer's own encoding without special tokens added, and to its decoding with none skipped. Rows and other columns
    stay as they are, whatever their names; columns of the new names are replaced. An empty table stays empty. table: from encoded_words(); by default of the most frequent words of docs.
    """
    new = ("n_tokens", *outputs)
    rest = docs.drop(*[c for c in docs.columns if c.lower() in new])
    known = encoded_words(distinct_words(docs, text), codec) if table is None else table
    shared = docs.sparkSession.sparkContext.broadcast((codec, known))
    state: dict = {}

    def opened():
        if not state:
            c, known = shared.value
            c.open()
            state["known"] = {w: i for b in known.to_batches(5000) for w, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
            state.update(codec=c, rare=[])
        return state["codec"], state["known"]

    def run(data, at):
        c, known = opened()
        get = known.get
        raw = memoryview(data)
        out, waiting, fresh, size = {o: [] for o in new}, [], set(), 0

        def done():
            if fresh:
                own = c.entries(sorted(fresh))
                known.update(own)
                state["rare"] += own
                fresh.clear()
            for words, ids in waiting:
                ids = ",".join(map(get, words)) if ids is None else ids
                decoded = c.decode(ids)
                out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                for o in outputs:
                    out[o].append(sha256(ids.encode()).hexdigest() if o == "ids_sha256" else sha256(decoded.encode()).hexdigest() if o == "decoded_sha256" else decoded if o == "decoded" else np.array(ids.split(","), np.int32) if ids else [])
            waiting.clear()
            if len(state["rare"]) > REMEMBERED:
                for w in state["rare"]:
                    known.pop(w, None)
                state["rare"] = []

        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            words = c.words(str(raw[a:b], "utf-8"))
            found = list(map(get, words))
            if None in found:
                fresh.update([w for w, x in zip(words, found, strict=True) if x is None])
                waiting.append((words, None))
            else:
                waiting.append((None, ",".join(found)))
            if (size := size + b - a) > 1_000_000:
                done()
                size = 0
        done()
        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return [pa.array(v, kinds.get(o, pa.string())) for o, v in out.items()]

    return map_texts(rest.withColumn(own := free(rest, "own_text"), F.col(text)), own, run, ", ".join(["n_tokens long", *[f"{o} {OUTPUTS[o]}" for o in outputs]]), state.clear)
