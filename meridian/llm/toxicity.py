"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings, of itself and of its first bytes, so that forms of one stem are near each other; filters of
several widths slide over the words, each filter's largest answer anywhere in the text goes to a logistic output. The threshold is calibrated for each language, which is identified from the text itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm import langid
from meridian.llm.common import free, map_texts, platt, sigmoid, spans
from meridian.llm.quality import labelled

BITS = 16
ROWS = 1 << BITS  # row ROWS of the embedding is zero and stands for no word
#: Bytes of a word's beginnings that have an embedding besides the whole word.
STEMS = (4, 5, 6, 7)
PARTS = 1 + len(STEMS)
DIMS, WIDTHS, FILTERS = 8, (1, 2, 3), 8
PAD = max(WIDTHS)
#: A score of this much and over is toxic; each language's own threshold is moved to it.
CUT = 0.3
PIECE = 500_000

#: 0: skipped (ASCII marks and digits), 1: between words, 2: part of a word.
_KIND = np.array([1 if b == 32 or 9 <= b <= 13 else 2 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words, and where each text's words begin and end. Case, digits and marks don't count."""
    kind = _KIND[data]
    kept = np.flatnonzero(kind)
    part = kind[kept] == 2
    before = np.concatenate([[False], part[:-1]]) if len(part) else part
    first = np.searchsorted(kept, at[:-1])
    before[first[first < len(before)]] = False
    starts = np.flatnonzero(part & ~before)
    if not len(starts):
        return np.zeros((0, PARTS), np.int32), np.zeros(len(at), np.int64)
    chars = np.flatnonzero(part)
    begin = np.searchsorted(chars, starts)
    length = np.diff(np.append(begin, len(chars)))
    place = np.arange(len(chars)) - np.repeat(begin, length)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[data[kept[chars]]] * _POWERS[place & 63])])
    out = np.empty((len(starts), PARTS), np.int32)
    for p, n in enumerate((None, *STEMS)):
        h = sums[begin + (length if n is None else np.minimum(n, length))] - sums[begin]
        h += np.uint64(p)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, p] = h >> np.uint64(64 - BITS)
    return out, np.searchsorted(kept[starts], at)


def padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with PAD empty ones after each text; where each text's windows begin and end, one window at least."""
    n = len(at) - 1
    length = np.diff(at)
    begin = at[:-1] + PAD * np.arange(n)
    out = np.full((len(ids) + PAD * n, PARTS), ROWS, np.int32)
    out[np.arange(len(ids)) + np.repeat(PAD * np.arange(n), length)] = ids
    return out, begin, begin + np.maximum(length, 1)


@dataclass
class Model:
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, DIMS, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: dict[str, float] = field(default_factory=dict)
    cut: float = 0.0
    slope: float = 1.0
    lang: langid.Model | None = None

    def pooled(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, argmax: bool = False):
        """Largest answers of all filters in each text; with argmax also where they are."""
        if end[-1] + PAD > len(ids):
            ids = np.concatenate([ids, np.full((PAD, PARTS), ROWS, np.int32)])
        cut = np.stack([begin, end], 1).reshape(-1)
        best, where = [], []
        n = int(end[-1])
        x = self.embed[ids[:, 0]]
        for p in range(1, PARTS):
            x += self.embed[ids[:, p]]
        y = x @ np.concatenate([f[j] for f in self.filters.values() for j in range(len(f))], 1)
        at = 0
        for w in WIDTHS:
            a = y[:n, at : at + FILTERS]
            for j in range(1, w):
                a = a + y[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            top = np.maximum.reduceat(np.concatenate([a, a[-1:]]), cut)[::2]
            best.append(top)
            if argmax:
                doc = np.repeat(np.arange(len(begin)), end - begin)
                rows = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange(len(doc))
                hit = a[rows] == top[doc]
                first = np.full(top.shape, n, np.int64)
                r, c = np.nonzero(hit)
                np.minimum.at(first, (doc[r], c), rows[r])
                where.append(first)
        best = np.maximum(np.concatenate(best, 1) + self.bias, 0)
        return (best, where) if argmax else best

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) == 2 and len(data) > PIECE:  # one long text: cut between words, filters see over the cuts
            ends = [0]
            while ends[-1] < len(data):
                e = min(ends[-1] + PIECE, len(data))
                while e < len(data) and _KIND[data[e]] != 1:
                    e += 1
                ends.append(e)
            ids = np.concatenate([words(data[a:b], np.array([0, b - a]))[0] for a, b in zip(ends, ends[1:], strict=False)])
            step = PIECE // 8
            best = []
            for i in range(0, max(len(ids), 1), step):
                part, begin, end = padded(ids[i : i + step + PAD], np.array([0, len(ids[i : i + step + PAD])]))
                best.append(self.pooled(part, begin, np.minimum(end, step)))  # windows that begin later belong to the next part
            return np.max(best, 0) @ self.out + self.out_bias
        return self.pooled(*padded(*words(data, at))) @ self.out + self.out_bias

    def score(self, z: np.ndarray, lang: np.ndarray) -> np.ndarray:
        cut = np.array([self.cuts.get(c, self.cut) for c in lang])
        return sigmoid(self.slope * (z - cut) + np.log(CUT / (1 - CUT)))


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02) -> Model:
    """Adam over mini-batches; only the winning windows get a gradient. Classes weigh the same.

    A dimension of the embedding begins as the word's log odds over the classes, which gives the filters a direction.
    """
    rng = np.random.default_rng(7)
    seen = np.zeros((2, ROWS + 1))
    for t, c in zip(texts, y, strict=True):
        seen[int(c), np.unique(t)] += 1
    odds = np.log((seen[1] + 0.5) / (sum(y == 1) + 1)) - np.log((seen[0] + 0.5) / (sum(y == 0) + 1))
    embed = rng.normal(0, 0.1, (ROWS + 1, DIMS)).astype(np.float32)
    embed[:, 0] = np.clip(odds, -3, 3) * np.minimum(1, seen.sum(0) / 5) / 3
    embed[ROWS] = 0
    filters = {w: rng.normal(0, 0.2, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS}
    for f in filters.values():
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.3
    m = Model(embed, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    params = {"embed": m.embed, "bias": m.bias, "out": m.out, **{f"f{w}": m.filters[w] for w in WIDTHS}}
    mom = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            at = np.concatenate([[0], np.cumsum([len(texts[k]) for k in pick])])
            ids, begin, end = padded(np.concatenate([texts[k] for k in pick]), at)
            ids = np.concatenate([ids, np.full((PAD, PARTS), ROWS, np.int32)])
            h, where = m.pooled(ids, begin, end, argmax=True)
            d = (weight[pick] * (sigmoid(h @ m.out + m.out_bias) - y[pick]) / len(pick)).astype(np.float32)
            grad = {k: 1e-4 * p for k, p in params.items()}
            grad["embed"] = np.zeros_like(m.embed)
            grad["out"] = grad["out"] + h.T @ d
            dh = d[:, None] * m.out * (h > 0)
            grad["bias"] = grad["bias"] + dh.sum(0)
            for k, w in enumerate(WIDTHS):
                g, pos = dh[:, k * FILTERS : (k + 1) * FILTERS], where[k]
                for j in range(w):
                    word = ids[pos + j]  # texts x filters x PARTS
                    grad[f"f{w}"][j] += np.einsum("tf,tfd->df", g, m.embed[word].sum(2))
                    back = g[:, :, None] * m.filters[w][j].T[None]
                    for p in range(PARTS):
                        np.add.at(grad["embed"], word[:, :, p].reshape(-1), back.reshape(-1, DIMS))
            grad["embed"][ROWS] = 0
            step += 1
            for k, p in params.items():
                a, b = mom[k]
                a += 0.1 * (grad[k] - a)
                b += 0.01 * (grad[k] ** 2 - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            m.embed[ROWS] = 0
            m.out_bias -= rate * float(d.sum())
    return m


def _best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the best F1, in the middle between its neighbours."""
    order = np.argsort(-z, kind="stable")
    z, hit, all_ = z[order], np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (y * weight).sum() + 1e-9)
    same = np.append(z[:-1] == z[1:], False)
    k = int(np.where(same, -1, f1).argmax())
    return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)


def calibrate(m: Model, z: np.ndarray, y: np.ndarray, weight: np.ndarray, lang: np.ndarray, least: int = 20) -> None:
    """One threshold for all, and one for each language that has at least so many rows of both classes."""
    if not (y == 1).any() or not (y == 0).any():
        m.cut, m.slope = (np.inf if not (y == 1).any() else -np.inf), 1.0
        return
    m.cut = _best_cut(z, y, weight)
    m.slope = max(platt(z, y, weight)[0], 1e-3)
    for c in np.unique(lang):
        own = lang == c
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= least:
            m.cuts[str(c)] = _best_cut(z[own], y[own], weight[own])


def fit(docs: DataFrame, labels: DataFrame, lang_model: langid.Model | None, label: str = "toxic", per_class: int = 1500, max_bytes: int = 50_000) -> Model | None:
    """A model of at most about per_class documents of each label, of at most max_bytes bytes; thresholds from a third of them that training
    does not see, weighed to the labels' own shares. None without labelled rows; without one of the classes every score is that of the other.
    """
    told = labels.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()
    n = {r[0]: r[1] for r in told}

    def hashed(data, at):
        ids, ends = words(data, at)
        langs = [lang_model.langs[i] if lang_model else "und" for a, b in spans(at) for i in (lang_model.predict(langid.features(data[at[a] : at[b]], at[a : b + 1] - at[a]))[0] if lang_model else [0] * (b - a))]
        return [pa.array([ids[a:b].astype(np.uint16).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array(langs, pa.string())]

    rows = sorted((r["_id"], r["label"], bytes(r["words"]), r["by"]) for r in map_texts(labelled(docs, labels, label, per_class, max_bytes).select("_id", "label", "text"), "text", hashed, "words binary, by string").collect())
    if not rows:
        return None
    y = np.array([r[1] for r in rows], float)
    texts = [np.frombuffer(r[2], np.uint16).astype(np.int32).reshape(-1, PARTS) for r in rows]
    lang = np.array([r[3] for r in rows], object)
    third = np.zeros(len(y), bool)
    for c in (0, 1):
        third[np.flatnonzero(y == c)[::3]] = (y == c).sum() >= 6
    use = np.flatnonzero(~third)
    m = train([texts[i] for i in use], y[use])
    m.lang = lang_model
    rest = np.flatnonzero(third) if third.any() else use
    z = np.concatenate([m.pooled(*padded(texts[i], np.array([0, len(texts[i])]))) @ m.out + m.out_bias for i in rest])
    weight = np.array([n[int(c)] / max(1, (y[rest] == c).sum()) for c in y[rest]])
    calibrate(m, z, y[rest], weight * len(rest) / weight.sum(), lang[rest])
    return m


def rate(docs: DataFrame, model: Model | None, text: str = "text", score: str = "toxic_score") -> DataFrame:
    """docs with a score of each whole text, 0 to 1; CUT and over is toxic. A null text counts as empty, and scores 0 without a model.

    Only text is looked at; its language is identified, not read. Rows and other columns stay as they are, whatever their names; a column of the new name is
    replaced. An empty table stays empty.
    """
    rest = docs.drop(*[c for c in docs.columns if c.lower() == score.lower()])
    if model is None:
        return rest.withColumn(score, F.lit(0.0))

    def run(data, at):
        out = [np.zeros(0)]
        for a, b in spans(at, 500_000):
            d, o = data[at[a] : at[b]], at[a : b + 1] - at[a]
            lang = np.array(model.lang.langs, object)[model.lang.predict(langid.features(d, o))[0]] if model.lang else ["und"] * (b - a)
            out.append(model.score(model.logits(d, o), lang))
        return [pa.array(np.concatenate(out), pa.float64())]

    return map_texts(rest.withColumn(own := free(rest, "own_text"), F.col(text)), own, run, f"`{score}` double")
