"""Quality by compression: zstandard dictionaries of good and of bad text.

Each piece of a text is compressed once with either dictionary. A text that the good dictionary shortens more than the bad one is like
good text: (size with bad - size with good) / (sum of both), summed over all pieces, goes through a logistic calibration.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import bounded_sample, free, map_texts, platt, sigmoid

LEVEL = 3
#: Short pieces keep the dictionaries' part large against what the text itself teaches the compressor.
PIECE = 1024
DICT_BYTES = 64 << 10


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few pieces to train on: they are the dictionary
        return b"".join(pieces)[-DICT_BYTES:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    a: float = 0.0
    b: float = 0.0

    def __post_init__(self):
        self._made = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "a": self.a, "b": self.b, "_made": None}

    def difference(self, text: memoryview | bytes) -> float:
        if self._made is None:
            self._made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False) for d in (self.good, self.bad)]
        good, bad = self._made
        g = b = 0
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            g += len(good.compress(piece))
            b += len(bad.compress(piece))
        return (b - g) / (b + g) if b + g else 0.0

    def score(self, d):
        return sigmoid(self.a * np.asarray(d, float) + self.b)


def train(texts: list[bytes], label: list[int]) -> Model:
    """Dictionaries of every other text of each class, calibration on the rest, with the classes' shares in texts as prior."""
    by = {c: [t for t, y in zip(texts, label, strict=True) if y == c] for c in (0, 1)}
    fit = {c: own[::2] if len(own) > 1 else own for c, own in by.items()}
    rest = [(t, c) for c, own in by.items() for t in (own[1::2] if len(own) > 1 else own)]
    model = Model(_dictionary(fit[1]) if fit[1] else b"", _dictionary(fit[0]) if fit[0] else b"")
    if rest:
        model.a, model.b = platt(np.array([model.difference(t) for t, _ in rest]), np.array([float(c) for _, c in rest]))
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, doc_id: str = "doc_id") -> DataFrame:
    """About per_class rows (text, label, n) of each label 0 and 1, n the label's rows in all; ids with a null or two different labels are left out. Of texts
    that share an id the greatest counts.

    The chosen ids, some thousands at most whatever the input, are broadcast to the documents.
    """
    told = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("label"), F.max(label).alias("most")).filter("label = most").select(F.col(doc_id).alias("_id"), "label")
    chosen = bounded_sample(told, "label", per_class, 2 * per_class, ["_id"])
    rows = docs.filter(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select(F.col(doc_id).alias("_id"), "text")
    return rows.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.max("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, max_bytes: int = 50_000) -> Model:
    """A model of at most about per_class documents of each label, of at most max_bytes bytes each. Without any, every score is 0.5."""
    rows = sorted((r["_id"], r["label"], r["text"]) for r in labelled(docs, labels, label, per_class, max_bytes).collect())
    return train([t.encode() for _, _, t in rows], [y for _, y, _ in rows])


def rate(docs: DataFrame, model: Model, text: str = "text", score: str = "quality_score") -> DataFrame:
    """docs with a score of each whole text, 0 to 1, higher for good; a null text counts as empty and has the prior's score.

    Rows and other columns stay as they are, whatever their names; a column of the new name is replaced. Long texts go by pieces. An empty table stays empty.
    """
    rest = docs.drop(*[c for c in docs.columns if c.lower() == score.lower()])

    def run(data, at):
        raw = memoryview(data)
        return [pa.array(model.score([model.difference(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]), pa.float64())]

    return map_texts(rest.withColumn(own := free(rest, "own_text"), F.col(text)), own, run, f"`{score}` double")
