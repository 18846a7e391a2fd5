"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

Two fingerprints of 64 bits that differ in at most 4 bits agree in at least 4 of their 8 bytes, each at its place. The index lists
fingerprints by positional bytes, three at a time so that lists stay short: of any 7 places a linked pair shares 3 at least. In a list, the
positional bytes that two fingerprints share are tallied; those with 4 or more are retained and verified by their differing bits.

Only different fingerprints are listed. A list links each fingerprint it reaches once, not in all pairs. A list of over LIST_MOST
fingerprints is split until no part is longer: linked pairs also share a further byte, or, once four bytes are fixed, one of any
five parts of the free bits. Links become components by repeated contraction, as tables in the shared folder.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import delete, durable, map_texts, owned, scratch, tidy, written

SEED = 42
BYTES = 8
LIST_MOST = 20_000
PIECE = 1_000_000
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _add(ones: np.ndarray, found: list[bytes], shingle: int) -> int:
    """Adds the set bits of all shingles of these words to ones; returns the shingles' number."""
    joined = b" ".join(found)
    length = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(length + 1) - 1
    h = xxhash.xxh64_intdigest
    n = len(found) - shingle + 1
    hashes = np.fromiter([h(joined[a:b], SEED) for a, b in zip((ends - length)[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], ">u8", n)
    for i in range(0, n, 1 << 14):
        ones += np.add.reduce(np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int64)
    return n


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bit by bit the majority of the shingles' hashes (a bit is set in over half); fewer words make one shingle, none make 0."""
    ones, n, carried, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        end = len(text)
        if at + PIECE < end:
            cut = _SPACE.search(text, at + PIECE)
            end = cut.start() if cut else end
        found = carried + _WORDS(bytes(text[at:end]).lower())
        if len(found) >= shingle:
            n += _add(ones, found, shingle)
            found = found[len(found) - shingle + 1 :] if shingle > 1 else []
        carried, at = found, end
    if not n and carried:
        n = _add(ones, carried, len(carried))
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, name: str = "_fp") -> DataFrame:
    """docs without text, with the fingerprint as a long. A null text has the fingerprint of an empty one, 0."""

    def run(data, at):
        raw = data.tobytes()
        made = [fingerprint(raw[a:b], shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [pa.array(np.array(made, np.uint64).view(np.int64), pa.int64())]

    return map_texts(docs, text, run, f"{name} long")


def _masks() -> list[int]:
    return [sum(255 << (8 * p) for p in places) for places in combinations(range(BYTES - 1), 3)]


def _children(mask: int, bits: int) -> list[int]:
    """Masks with more fixed bits, of which a linked pair that agrees in mask agrees in one at least."""
    places = [p for p in range(BYTES) if mask >> (8 * p) & 255 == 255]
    if len(places) < BYTES - bits:
        return [mask | 255 << (8 * p) for p in range(BYTES) if p not in places]
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part) for k in range(bits + 1) if (part := free[k :: bits + 1])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Tally of shared positional bytes, then the differing bits."""
    x = a ^ b
    shared = np.zeros(len(x), np.int8)
    for p in range(BYTES):
        shared += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
    keep = np.flatnonzero(shared >= BYTES - bits)
    out = np.zeros(len(x), bool)
    out[keep] = np.bitwise_count(x[keep]) <= bits
    return out


def _tree(f: np.ndarray, bits: int) -> tuple[list, list]:
    """Links that connect all that is connected in one list, one for each fingerprint reached."""
    left, a, b = f, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = _linked(left, np.full(len(left), x, np.uint64), bits)
            if hit.any():
                new = left[hit]
                a.append(np.full(len(new), x, np.uint64))
                b.append(new)
                todo.extend(new)
                left = left[~hit]
    return a, b


def _list_links(bits: int):
    def of(key: np.ndarray, fp: np.ndarray):
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        a, b = [], []
        for m in np.unique(size[(size > 1) & (size <= 8)]):
            own = start[size == m]
            for i, j in combinations(range(m), 2):
                hit = _linked(fp[own + i], fp[own + j], bits)
                a.append(fp[own[hit] + i])
                b.append(fp[own[hit] + j])
        for s, m in zip(start[size > 8], size[size > 8], strict=True):
            x, y = _tree(fp[s : s + m], bits)
            a += x
            b += y
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):  # rows come sorted by key; the last list of a batch may go on in the next
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if len(key) and key[0] != key[-1]:
                last = int(np.searchsorted(key, key[-1]))
                yield of(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield of(key, fp)

    return run


def links(nodes: DataFrame, bits: int = 4, fp: str = "_fp", list_most: int = LIST_MOST) -> DataFrame:
    """Columns a, b: links among the distinct fingerprints of nodes that join all fingerprints that links of at most `bits` bits join."""
    spark = nodes.sparkSession
    rows = nodes.select(F.col(fp).alias("fp"), F.explode(F.array(*[F.lit(_signed(m)) for m in _masks()])).alias("mask"))
    masks, found = _masks(), None
    while True:
        keyed = rows.withColumn("key", F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "mask"))
        long = durable(keyed.groupBy("key").count().filter(F.col("count") > list_most).select("key"), "simhash-long")
        split = not long.isEmpty()
        short = keyed.join(long, "key", "left_anti") if split else keyed
        dealt = short.select("key", "fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
        made = dealt.mapInArrow(tidy(_list_links(bits)), "a long, b long")
        found = made if found is None else found.unionByName(made)
        if not split:
            return durable(found.distinct(), "simhash-links")
        children = [(_signed(m), _signed(c)) for m in masks for c in _children(m, bits)]
        masks = sorted({c & (2**64 - 1) for _, c in children})
        more = spark.createDataFrame(children, "mask long, child long")
        rows = durable(keyed.join(long, "key", "left_semi").join(F.broadcast(more), "mask").select("fp", F.col("child").alias("mask")).distinct(), "simhash-split")


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root of all nodes with an edge (a, b): nodes are connected if and only if their roots are equal.

    Each round maps every node to the first of itself and its neighbours and contracts the edges by that map. First is by a hash of round and node, new in each round, so
    no order of the nodes, a chain in ascending order neither, needs more than a number of rounds that grows with the logarithm of the longest path. Only
    minima are aggregated, so a node with very many neighbours makes no large group. A round's tables are deleted when the next one's are written.
    """
    spark = edges.sparkSession
    edges, edges_path = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    root, root_path, turn = None, None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        of = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        step, step_path = written(both.groupBy("a").agg(F.min(of("b")).alias("_b")).select(F.col("a").alias("node"), F.least(of("a"), "_b")["node"].alias("to")), "step")
        old = [edges_path]
        if root is None:
            root, root_path = step.withColumnRenamed("to", "root"), step_path
        else:
            old += [root_path, step_path]
            root, root_path = written(root.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b")
        edges, edges_path = written(moved.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        for path in old:
            delete(spark, path)
        turn += 1
    if root is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    delete(spark, edges_path)
    owned(root_path)
    return root


def _marked(docs: DataFrame, text: str, doc_id: str, shingle: int, bits: int, list_most: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with _id, keep_0 and so on, _fp; and for each _fp component_id and root."""
    if not 0 <= bits <= 4:
        raise ValueError("the index finds links of 4 bits at most")
    carried = docs.select(F.col(doc_id).alias("_id"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    rows = durable(fingerprints(carried, "_text", shingle), "simhash")
    with scratch(docs.sparkSession):
        nodes = durable(rows.groupBy("_fp").agg(F.min("_id").alias("least")), "simhash-nodes")
        comp = components(links(nodes, bits, list_most=list_most))
        rooted, path = written(nodes.join(comp.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "least", F.coalesce("root", "_fp").alias("root")), "simhash-roots")
    owned(path)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, rooted.join(least, "root").select("_fp", "component_id", "root")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, bits: int = 4, list_most: int = LIST_MOST) -> DataFrame:
    """Columns doc_id, fingerprint (16 hexadecimal digits) and component_id, for each row.

    component_id: the smallest id that links of at most `bits` differing bits reach, that of the row included. Texts without a word,
    null ones too, have fingerprint 0 and link like others. A null id has a component but is nobody's smallest; it is null where no row of
    it has an id. Rows that repeat are linked. bits: 4 at most. An empty table gives no rows.
    """
    rows, roots = _marked(docs, text, doc_id, shingle, bits, list_most, [])
    return rows.join(roots, "_fp").select(F.col("_id").alias(doc_id), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, bits: int = 4, list_most: int = LIST_MOST) -> DataFrame:
    """One row of docs for each component, that with the smallest id; columns as before. Of rows equal in id, or all without one, any one stays.

    The row to keep is found from ids and fingerprints alone, by minima that each partition takes first, so a component with a third of all
    rows makes no large group; only then are whole rows dealt, once, by their own key.
    """
    rows, roots = _marked(docs, text, doc_id, shingle, bits, list_most, docs.columns)
    key = [F.col("_id").isNull().alias("none"), F.coalesce("_id", F.lit("0").cast(rows.schema["_id"].dataType)).alias("id"), F.col("_fp").alias("fp")]
    best = durable(rows.select("_fp", *key).join(roots, "_fp").groupBy("root").agg(F.min(F.struct("none", "id", "fp")).alias("best")).select("best.*"), "simhash-kept")
    row = F.struct(*[f"keep_{i}" for i in range(len(docs.columns))]).alias("row")
    kept = rows.select(*key, row).join(best, ["none", "id", "fp"], "left_semi").groupBy("none", "id", "fp").agg(F.first("row").alias("row"))
    return kept.select(*[F.col(f"row.keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
