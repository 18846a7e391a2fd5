"""Language identification by hierarchical discrimination.

A text becomes the square roots of the shares of its hashed byte trigrams, letters only. A softmax over these predicts the family
of languages; within a family, linear support vector machines, one for each pair of its languages, vote.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import bounded_sample, free, map_texts, platt, sigmoid, spans

DIM_BITS = 12
DIM = 1 << DIM_BITS
#: Families of closely related languages, by ISO 639-1 code; a language in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
#: Letters in lower case, bytes of other scripts as they are, all else a space.
LETTER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)
PIECE = 1_000_000


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    if len(data) < 3:
        return np.zeros((n, DIM))
    x = LETTER[data]
    code = ((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761) >> np.uint32(32 - DIM_BITS)
    doc = np.repeat(np.arange(n), np.diff(at))
    inside = doc[:-2] == doc[2:]
    return np.bincount((doc[:-2] * DIM + code)[inside], minlength=n * DIM).reshape(n, DIM)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text. A text over the size of a piece is counted piece by piece."""
    if len(at) == 2 and at[1] - at[0] > PIECE:
        c = sum(_counts(data[i : i + PIECE + 2], np.array([0, min(PIECE + 2, len(data) - i)])) for i in range(0, len(data), PIECE))
    else:
        c = _counts(data, at)
    return np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1)).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    families: list[list[int]]  # of indices into langs
    family_w: np.ndarray
    pairs: list[tuple[int, int]]
    pair_w: np.ndarray
    pair_cal: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score, 0 to 1, of each row."""
        x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
        z = x1 @ self.family_w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        family = p.argmax(1)
        margin = x1 @ self.pair_w
        votes, sure = np.zeros((len(x), len(self.langs))), np.ones((len(x), len(self.langs)))
        for k, (i, j) in enumerate(self.pairs):
            q = sigmoid(self.pair_cal[k, 0] * margin[:, k] + self.pair_cal[k, 1])
            votes[:, i] += (margin[:, k] > 0) + 1e-3 * q
            votes[:, j] += (margin[:, k] <= 0) + 1e-3 * (1 - q)
            sure[:, i], sure[:, j] = np.minimum(sure[:, i], q), np.minimum(sure[:, j], 1 - q)
        member = np.zeros((len(self.families), len(self.langs)), bool)
        for f, own in enumerate(self.families):
            member[f, own] = True
        best = np.where(member[family], votes, -1).argmax(1)
        rows = np.arange(len(x))
        return best, np.clip(p[rows, family] * sure[rows, best], 0, 1)


def _fit(x: np.ndarray, grad, width: int, steps: int = 300, rate: float = 0.2) -> np.ndarray:
    """Adam on all rows at once."""
    w, m, v = (np.zeros((x.shape[1], width), np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = x.T @ grad(x @ w) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return w


def train(x: np.ndarray, lang: list[str]) -> Model:
    langs = sorted(set(lang))
    of = {c: f for f, own in FAMILIES.items() for c in own}
    names = sorted({of.get(c, c) for c in langs})
    families = [[i for i, c in enumerate(langs) if of.get(c, c) == f] for f in names]
    y = np.array([langs.index(c) for c in lang])
    yf = np.array([names.index(of.get(c, c)) for c in lang])
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    balance = (1 / np.bincount(yf))[yf] * len(yf) / len(names)
    one = np.eye(len(names), dtype=np.float32)[yf]

    def softmax(z):
        p = np.exp(z - z.max(1, keepdims=True))
        return (p / p.sum(1, keepdims=True) - one) * balance[:, None].astype(np.float32)

    family_w = _fit(x1, softmax, len(names))
    pairs = [(a, b) for own in families for i, a in enumerate(own) for b in own[i + 1 :]]
    pair_w, cal = np.zeros((x1.shape[1], len(pairs)), np.float32), np.zeros((len(pairs), 2))
    for k, (a, b) in enumerate(pairs):
        rows = np.flatnonzero((y == a) | (y == b))
        s = np.where(y[rows] == a, 1.0, -1.0)[:, None].astype(np.float32)
        each = np.where(s > 0, len(s) / (2 * (s > 0).sum()), len(s) / (2 * (s < 0).sum())).astype(np.float32)
        w = _fit(x1[rows], lambda z: -2 * each * s * np.maximum(0, 1 - s * z), 1)  # squared hinge  # noqa: B023
        pair_w[:, k] = w[:, 0]
        cal[k] = platt((x1[rows] @ w)[:, 0], (s[:, 0] > 0).astype(float))
    return Model(langs, families, family_w, pairs, pair_w, cal)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 800, total: int = 4000, max_bytes: int = 100_000) -> Model | None:
    """A model learned from at most about `total` rows of docs, `per_lang` of each language, texts of at most max_bytes bytes; None without any.

    The sample is chosen by a hash of the text; only its hashed counts come to the driver.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= max_bytes)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    chosen = bounded_sample(rows, "lang", per_lang, total, ["text"]).filter(F.col("text").rlike(r"\p{L}"))

    def sparse(data, at):
        out = []
        for a, b in spans(at):
            out += [r.astype(np.float16).tobytes() for r in features(data[at[a] : at[b]], at[a : b + 1] - at[a])]
        return [pa.array(out, pa.binary())]

    found = sorted((r["lang"], bytes(r["x"])) for r in map_texts(chosen, "text", sparse, "x binary").collect())
    if not found:
        return None
    return train(np.stack([np.frombuffer(b, np.float16) for _, b in found]).astype(np.float32), [c for c, _ in found])


def identify(docs: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with a language and a score, 0 to 1, of each whole text; no column but text is looked at.

    A null text and one without a letter are `und` with score 0, and so is every text if there was nothing to learn from. Rows and other
    columns stay as they are, whatever their names; columns of the new names are replaced. Texts of any length are counted in pieces. An empty table stays empty.
    """
    rest = docs.drop(*[c for c in docs.columns if c.lower() in (pred.lower(), score.lower())])
    if model is None:
        return rest.withColumns({pred: F.lit("und"), score: F.lit(0.0)})
    langs = np.array(model.langs, object)

    def label(data, at):
        best, sure = [np.zeros(0, int)], [np.zeros(0)]
        for a, b in spans(at):
            i, s = model.predict(features(data[at[a] : at[b]], at[a : b + 1] - at[a]))
            best.append(i)
            sure.append(s)
        return [pa.array(langs[np.concatenate(best)], pa.string()), pa.array(np.concatenate(sure).astype(float), pa.float64())]

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own, told, found, sure = (free(rest, f"own_{c}") for c in ("text", "lettered", "lang", "score"))
    both = rest.withColumns({own: F.col(text), told: lettered})
    return map_texts(both, own, label, f"`{found}` string, `{sure}` double").select(
        *[F.col(f"`{c}`") for c in rest.columns], F.when(F.col(told), F.col(found)).otherwise("und").alias(pred), F.when(F.col(told), F.col(sure)).otherwise(0.0).alias(score)
    )
