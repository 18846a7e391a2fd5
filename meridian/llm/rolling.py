"""Exact rolling medians and median absolute deviations over time windows.

A series is cut into chunks of one window's length. A chunk gets its own rows and, as its halo, the rows of the chunk before, so every window that ends in it
is there. Inside a task each chunk is a lane: its amounts are compressed to ranks, and as time goes on two pointers (rows that come in, rows that fall out)
update the lane's Fenwick tree. A descent of the tree finds the median; a bisection of the radius around it, which counts the rows in range by two prefix sums,
finds the median absolute deviation. Many lanes go forward together, one numpy call for all of them at each step.

A chunk with more rows than a stated bound is cut further, into slices of nearly equal numbers of rows. A slice has three kinds of rows: those that come in, those
that fall out while it lasts, and a histogram of those that stay all the time, so that no task holds all rows of a dense window. Rows of one instant and
amount are summed before they are dealt.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.llm.common import durable, tidy

#: Rows of a chunk; beyond it is cut into slices.
CHUNK_ROWS = 50_000
#: Times in a window at which a dense chunk may be cut.
BINS = 4096
#: Amounts beyond this many cents, and those that are no numbers, count as none: sums of a few of them would not fit 64 bits.
MOST_CENTS = 1 << 58
#: Rows that a task takes on at once, and cells of the trees that it holds at once.
TASK_ROWS, TREE_CELLS = 400_000, 4_000_000
OWN, LEAVING, STAYING = 0, 1, 2


def micros(time: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp, of one without a zone as it is written."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(time)
    parts = F.unix_date(time.cast("date")).cast("long") * 86_400, F.hour(time) * 3600, F.minute(time) * 60
    return reduce(Column.__add__, parts) * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def cents_of(value: Column) -> Column:
    """floor(100 * value + 0.5); null for null, for what is no finite number and beyond MOST_CENTS."""
    c = F.floor(100 * value + 0.5)
    return F.when(F.abs(100 * value) < MOST_CENTS, c)  # false for NaN and infinite values too: NaN is above all numbers


# --- numpy: lanes of Fenwick trees


def _paths(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each rank up to size (a power of two): the cells that an update touches, and those that a prefix sum reads. Cell 0 stays zero; cell size + 1 takes what goes nowhere."""
    ranks, levels = np.arange(size + 1), size.bit_length()
    up, down = np.full((size + 1, levels), size + 1, np.int64), np.zeros((size + 1, levels), np.int64)
    a, b = ranks.copy(), ranks.copy()
    a[0] = size + 1
    for k in range(levels):
        up[:, k] = np.minimum(a, size + 1)
        down[:, k] = b
        a = np.where(a <= size, a + (a & -a), size + 1)
        b = b & (b - 1) * (b > 0)
    return up, down


class Lanes:
    """Fenwick trees over the ranks of amounts, one a lane."""

    def __init__(self, amounts: np.ndarray, first: np.ndarray, counts: np.ndarray):
        """amounts: distinct ones, ascending in each lane; first: where each lane's begin, and the end; counts: what each amount starts with."""
        self.first, lanes = first, len(first) - 1
        most = int(np.diff(first).max(initial=1))
        self.size = 1 << max(0, (most - 1).bit_length())
        self.up, self.down = _paths(self.size)
        self.stride = self.size + 2
        own = np.repeat(np.arange(lanes), np.diff(first))
        sums = np.zeros((lanes, self.stride), np.int64)
        sums[own, np.arange(len(amounts)) - first[own] + 1] = counts
        self.total = sums.sum(1)
        sums = np.cumsum(sums, 1)
        ranks = np.arange(1, self.size + 1)
        tree = np.zeros_like(sums)
        tree[:, 1 : self.size + 1] = sums[:, ranks] - sums[:, ranks & (ranks - 1)]
        self.tree = tree.ravel()
        self.amounts = amounts
        self.low = int(amounts.min()) if len(amounts) else 0
        self.span = (int(amounts.max()) - self.low if len(amounts) else 0) + 3
        self.keys = own * self.span + (amounts - self.low + 1)

    def add(self, lane: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> None:
        np.add.at(self.tree, (lane * self.stride)[:, None] + self.up[rank], weight[:, None])
        np.add.at(self.total, lane, weight)

    def prefix(self, lane: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return self.tree[(lane * self.stride)[:, None] + self.down[rank]].sum(1)

    def kth(self, lane: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest amount (from 1) by descent."""
        at, left, base, step = np.zeros(len(lane), np.int64), k.copy(), lane * self.stride, self.size
        while step:
            to = at + step
            there = self.tree[base + np.minimum(to, self.size)]
            down = (to <= self.size) & (there < left)
            left -= there * down
            at += step * down
            step >>= 1
        return self.amounts[self.first[lane] + at]

    def rank(self, lane: np.ndarray, amount: np.ndarray) -> np.ndarray:
        """How many distinct amounts of the lane are no larger."""
        return np.searchsorted(self.keys, lane * self.span + np.clip(amount - self.low + 1, 0, self.span - 1), "right") - self.first[lane]

    def between(self, lane: np.ndarray, middle2: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows below, and rows below or within: those with |2 * amount - middle2| <= radius are within."""
        return self.prefix(lane, self.rank(lane, -((radius - middle2) // 2) - 1)), self.prefix(lane, self.rank(lane, (middle2 + radius) // 2))

    def radius(self, lane: np.ndarray, middle2: np.ndarray, k: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """The smallest radius around middle2 / 2, doubled, that holds k rows: bisection, in steps that double away from a guess."""
        low, step = np.zeros(len(lane), np.int64), np.ones(len(lane), np.int64)
        high = np.maximum(middle2 - 2 * self.amounts[self.first[lane]], 2 * self.amounts[self.first[lane + 1] - 1] - middle2)
        below, above = np.zeros(len(lane), bool), np.zeros(len(lane), bool)
        at, todo = np.minimum(guess, high), np.arange(len(lane))
        while len(todo):
            t = at[todo]
            a, b = self.between(lane[todo], middle2[todo], t)
            enough = b - a >= k[todo]
            high[todo] = np.where(enough, t, high[todo])
            low[todo] = np.where(enough, low[todo], t + 1)
            above[todo] |= enough
            below[todo] |= ~enough
            lo, hi, s = low[todo], high[todo], step[todo]
            at[todo] = np.where(above[todo] & below[todo], (lo + hi) // 2, np.where(enough, np.maximum(lo, hi - s), np.minimum(hi, lo + s)))
            step[todo] = 2 * s
            todo = todo[lo < hi]
        return high

    def farther(self, lane: np.ndarray, middle2: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The next larger deviation; there is one."""
        a, b = self.between(lane, middle2, radius)
        none = np.iinfo(np.int64).max
        left, right = np.full(len(lane), none), np.full(len(lane), none)
        i, j = np.flatnonzero(a > 0), np.flatnonzero(b < self.total[lane])
        left[i] = middle2[i] - 2 * self.kth(lane[i], a[i])
        right[j] = 2 * self.kth(lane[j], b[j] + 1) - middle2[j]
        return np.minimum(left, right)


def windows(lane: np.ndarray, us: np.ndarray, amount: np.ndarray, has: np.ndarray, role: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """For each instant of a lane's own rows: lane, instant, n, doubled median, doubled median of deviations; the last two mean nothing where n < 2.

    Rows: lane (0 and up, in order), microseconds, amount where has, role, weight. LEAVING rows are older than the lane's own and inside the first window or
    before it; STAYING ones are in all windows of the lane, whatever their time.
    """
    own = role == OWN
    instants = np.unique(np.stack([lane[own], us[own]]), axis=1) if own.any() else np.zeros((2, 0), np.int64)
    q_lane, q_us = instants
    out = [np.zeros(len(q_lane), np.int64) for _ in range(3)]
    lanes = int(lane.max(initial=-1)) + 1
    asked, starts = np.bincount(q_lane, minlength=lanes), np.concatenate([[0], np.cumsum(np.bincount(q_lane, minlength=lanes))])
    held = np.flatnonzero(has & (asked[lane] > 0))
    order = held[np.lexsort((amount[held], lane[held]))]
    new = np.ones(len(order), bool)
    new[1:] = (lane[order][1:] != lane[order][:-1]) | (amount[order][1:] != amount[order][:-1])
    number = np.cumsum(new) - 1  # of the distinct amounts
    d_lane, d_amount = lane[order][new], amount[order][new]
    d_first = np.searchsorted(d_lane, np.arange(lanes + 1))
    rank = np.zeros(len(lane), np.int64)
    rank[order] = number - d_first[lane[order]] + 1
    # the step of its lane at which a row comes in or falls out
    span = int(max(us.max(initial=0), q_us.max(initial=0)) + width - us.min(initial=0) + 2)
    base = int(us.min(initial=0))
    most = max(1, (1 << 62) // span)  # lanes whose times can stand in one key
    step = np.zeros(len(lane), np.int64)
    for lo in range(0, lanes, most):
        i = held[(lane[held] >= lo) & (lane[held] < lo + most)]
        keys = (q_lane[starts[lo] : starts[min(lo + most, lanes)]] - lo) * span + (q_us[starts[lo] : starts[min(lo + most, lanes)]] - base)
        when = us[i] - base + np.where(role[i] == LEAVING, width + 1, 0)
        step[i] = np.searchsorted(keys, (lane[i] - lo) * span + when) + starts[lo] - starts[lane[i]]
    by_size = np.argsort(-asked, kind="stable")
    by_size = by_size[asked[by_size] > 0]
    at = 0
    together = min(4096, (1 << 62) // (int(d_amount.max(initial=0)) - int(d_amount.min(initial=0)) + 3))  # lanes whose amounts can stand in one key
    while at < len(by_size):
        end, widest = at, 1
        while end < len(by_size):
            wide = max(widest, int(d_first[by_size[end] + 1] - d_first[by_size[end]]))
            if end > at and ((1 << wide.bit_length()) * (end - at + 1) > TREE_CELLS or end - at >= together):
                break
            widest, end = wide, end + 1
        _run(by_size[at:end], asked, starts, q_us, lane, rank, role, weight, step, held, d_amount, d_first, out)
        at = end
    return q_lane, q_us, *out


def _run(chosen, asked, starts, q_us, lane, rank, role, weight, step, held, d_amount, d_first, out) -> None:
    """windows() for the chosen lanes, most instants first: all go forward together."""
    new_lane = np.full(len(asked), -1, np.int64)
    new_lane[chosen] = np.arange(len(chosen))
    sizes = d_first[chosen + 1] - d_first[chosen]
    first = np.concatenate([[0], np.cumsum(sizes)])
    pick = np.repeat(d_first[chosen] - first[:-1], sizes) + np.arange(first[-1])
    rows = held[new_lane[lane[held]] >= 0]
    mine, r, w, s, kind = new_lane[lane[rows]], rank[rows], weight[rows], step[rows], role[rows]
    start = (kind == STAYING) | ((kind == LEAVING) & (s > 0))
    counts = np.zeros(first[-1], np.int64)
    np.add.at(counts, first[mine[start]] + r[start] - 1, w[start])
    trees = Lanes(d_amount[pick], first, counts)
    change = (kind == OWN) | ((kind == LEAVING) & (s > 0) & (s < asked[chosen][mine]))
    mine, r, s, w = mine[change], r[change], s[change], np.where(kind == OWN, w, -w)[change]
    order = np.argsort(s, kind="stable")
    mine, r, w = mine[order], r[order], w[order]
    times = int(asked[chosen[0]])
    cut = np.searchsorted(s[order], np.arange(times + 1))
    active = np.searchsorted(-asked[chosen], -np.arange(times), "left")  # lanes with more instants than the step
    place = starts[chosen]
    guess = np.zeros(len(chosen), np.int64)
    for j in range(times):
        a, b = cut[j], cut[j + 1]
        if b > a:
            trees.add(mine[a:b], r[a:b], w[a:b])
        live = np.arange(active[j])
        n = trees.total[live]
        out[0][place[live] + j] = n
        live, n = live[n >= 2], n[n >= 2]
        if not len(live):
            continue
        k1, k2 = (n + 1) // 2, n // 2 + 1
        both = trees.kth(np.concatenate([live, live]), np.concatenate([k1, k2]))
        middle2 = both[: len(live)] + both[len(live) :]
        near = trees.radius(live, middle2, k1, guess[live])
        guess[live] = near
        mad = 2 * near
        even = np.flatnonzero(k2 > k1)
        lo, hi = trees.between(live[even], middle2[even], near[even])
        more = even[hi - lo < k2[even]]
        mad[more] = near[more] + trees.farther(live[more], middle2[more], near[more])
        out[1][place[live] + j] = middle2
        out[2][place[live] + j] = mad


# --- Spark: chunks and their halo


def _chunks(batches, keys: list[str], do):
    """do() over tables of whole chunks (rows with equal keys stand together) and the number of each row's chunk."""
    kept, rows = [], 0

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            a, b = c.slice(0, len(c) - 1), c.slice(1)
            new[1:] |= pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False).astype(bool)
        return new

    for b in batches:
        kept.append(b)
        rows += b.num_rows
        if rows >= TASK_ROWS:
            t = pa.Table.from_batches(kept).combine_chunks()
            new = cut(t)
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if last:
                yield from do(t.slice(0, last), np.cumsum(new[:last]))
            kept = t.slice(last).to_batches()
            rows = t.num_rows - last
    if rows:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield from do(t, np.cumsum(cut(t)))


def _ints(t: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(t.column(name), 0).to_numpy().astype(np.int64)


def _whole(rows: DataFrame, width: int, own: Column, halo: Column) -> DataFrame:
    """Figures of the own rows from chunks of one width and the chunk before; halo: which rows the chunk after needs."""
    here = F.struct(F.col("h"), F.lit(OWN).cast("byte").alias("role"), "id")
    next_ = F.struct((F.col("h") + 1).alias("h"), F.lit(LEAVING).cast("byte").alias("role"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"))
    copies = F.array_compact(F.array(F.when(own, here), F.when(halo & F.col("cents").isNotNull(), next_)))
    dealt = rows.withColumn("e", F.explode(copies)).select("s", "e.h", "e.role", "us", "cents", "e.id")
    dealt = dealt.repartition("s", "h").sortWithinPartitions("s", "h")

    def figures(t, lane):
        role, us = _ints(t, "role"), _ints(t, "us")
        has = pc.is_valid(t.column("cents")).to_numpy()
        q_lane, q_us, n, middle2, mad = windows(lane, us, _ints(t, "cents"), has, role, np.ones(len(us), np.int64), width)
        mine = np.flatnonzero(role == OWN)
        at = _find(q_lane, q_us, lane[mine], us[mine])
        own = t.take(pa.array(mine))
        few = n[at] < 2
        yield from pa.table([own["id"], own["s"], own["cents"], pa.array(n[at]), pa.array(middle2[at], mask=few), pa.array(mad[at], mask=few)], names=["id", "s", "cents", "n", "median2", "mad4"]).to_batches()

    out = T.StructType([rows.schema["id"], rows.schema["s"], *T.StructType.fromDDL("cents long, n long, median2 long, mad4 long")])
    return dealt.mapInArrow(tidy(lambda batches: _chunks(batches, ["s", "h"], figures)), out)


def _find(q_lane, q_us, lane, us) -> np.ndarray:
    """Where each (lane, us) stands among the sorted instants."""
    first = np.searchsorted(q_lane, lane)
    order = np.lexsort((us, lane))
    new = np.ones(len(order), bool)
    new[1:] = (lane[order][1:] != lane[order][:-1]) | (us[order][1:] != us[order][:-1])
    at = np.zeros(len(order), np.int64)
    at[order] = np.cumsum(new) - 1  # all instants are own rows', so they are numbered alike
    assert len(order) == 0 or (at >= first).all()
    return at


def _matched(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a joined with b where all of on are equal, null with null, by a shuffle; columns of a, then the others of b."""
    other = b.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in b.columns if c not in on])
    return a.join(other.hint("merge"), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]), how).drop(*[f"_{c}" for c in on])


def _sliced(rows: DataFrame, points: DataFrame, dense: DataFrame, width: int, chunk_rows: int) -> DataFrame:
    """Figures of rows in dense chunks: slices of at most chunk_rows points and one bin, or so."""
    bin_of = lambda t: F.floor((t - F.col("h") * width) * BINS / F.lit(width)).cast("int")
    come = points.withColumn("t", F.col("us")).withColumn("role", F.lit(OWN).cast("byte"))
    go = points.filter("cents is not null").withColumn("h", F.col("h") + 1).withColumn("t", F.col("us") + width).withColumn("role", F.lit(LEAVING).cast("byte"))
    events = come.unionByName(go)
    events = durable(_matched(events, dense, ["s", "h"], "left_semi").withColumn("bin", bin_of(F.col("t"))), "rolling-events")
    chunk = Window.partitionBy("s", "h")  # BINS rows at most
    bins = events.groupBy("s", "h", "bin").agg(F.count("*").alias("points")).withColumn("before", F.sum("points").over(chunk.orderBy("bin")) - F.col("points"))
    bins = bins.withColumn("slice", F.floor(F.col("before") / chunk_rows).cast("int")).withColumn("last", F.max("slice").over(chunk)).select("s", "h", "bin", "slice", "last")
    placed = _matched(events, bins, ["s", "h", "bin"])
    later, sooner = F.sequence(F.col("slice") + 1, F.col("last")), F.sequence(F.lit(0), F.col("slice") - 1)
    stay = placed.filter("cents is not null and last > 0").groupBy("s", "h", "role", "slice", "last", "cents").agg(F.sum("w").alias("w"))
    stay = stay.filter(f"(role = {OWN} and slice < last) or (role = {LEAVING} and slice > 0)").withColumn("to", F.explode(F.when(F.col("role") == OWN, later).otherwise(sooner)))
    stay = stay.select("s", "h", F.col("to").alias("slice"), F.lit(STAYING).cast("byte").alias("role"), (F.col("h") * width).alias("us"), "cents", "w")
    dealt = placed.select("s", "h", "slice", "role", "us", "cents", "w").unionByName(stay).repartition("s", "h", "slice").sortWithinPartitions("s", "h", "slice")

    def figures(t, lane):
        role = _ints(t, "role")
        q_lane, q_us, n, middle2, mad = windows(lane, _ints(t, "us"), _ints(t, "cents"), pc.is_valid(t.column("cents")).to_numpy(), role, _ints(t, "w"), width)
        starts = np.searchsorted(lane, np.arange(int(lane[-1]) + 1))
        few = n < 2
        yield from pa.table([t["s"].take(pa.array(starts[q_lane])), pa.array(q_us), pa.array(n), pa.array(middle2, mask=few), pa.array(mad, mask=few)], names=["s", "us", "n", "median2", "mad4"]).to_batches()

    out = T.StructType([rows.schema["s"], *T.StructType.fromDDL("us long, n long, median2 long, mad4 long")])
    found = dealt.mapInArrow(tidy(lambda batches: _chunks(batches, ["s", "h", "slice"], figures)), out)
    return _matched(rows, found, ["s", "us"]).select("id", "s", "cents", "n", "median2", "mad4")


def rolling(clicks: DataFrame, id: str = "click_id", time: str = "ts", series: str = "kind", value: str = "value", minutes: int = 60, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For each id once: n, median2 and mad4 of the amounts (cents) of its series in the window that ends at its own time, both ends included; far: whether its own amount
    is farther from the median than 1.5 times that deviation. Columns id, series, n, median2, mad4, far, under the names given.

    Rows without a time are dropped. Rows that share an id count once; where they differ, the smallest (time, series, cents) stands, null first; a null id is an id like any
    other, and null is a series. A row without a value, or with one that is no finite number or over MOST_CENTS, has no cents: it gets a row and far is null. Ties in time are in
    each other's windows. With n < 2, median2, mad4 and far are null. Other columns are not read, whatever their names; an empty table gives none.
    """
    width = minutes * 60_000_000
    first = F.struct(micros(F.col(time), clicks.schema[time].dataType).alias("us"), F.col(series).alias("s"), cents_of(F.col(value)).alias("cents"))
    rows = clicks.filter(F.col(time).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(first).alias("v")).select("id", "v.s", "v.us", "v.cents")
    rows = durable(rows.withColumn("h", F.floor(F.col("us") / F.lit(width)).cast("long")), "rolling", keep=True)
    cells = rows.groupBy("s", "h").agg(F.count("*").alias("own")).withColumn("halo", F.lit(0).cast("long"))
    cells = cells.unionByName(cells.select("s", (F.col("h") + 1).alias("h"), F.lit(0).cast("long").alias("own"), F.col("own").alias("halo")))
    dense = durable(cells.groupBy("s", "h").agg(F.sum("own").alias("own"), F.sum("halo").alias("halo")).filter((F.col("own") > 0) & (F.col("own") + F.col("halo") > chunk_rows)).select("s", "h"), "rolling-dense", keep=True)
    if dense.isEmpty():
        found = _whole(rows, width, F.lit(True), F.lit(True))
    else:
        marks = dense.select("s", "h", F.lit(True).alias("dense"), F.lit(False).alias("ahead"))
        marks = marks.unionByName(dense.select("s", (F.col("h") - 1).alias("h"), F.lit(False).alias("dense"), F.lit(True).alias("ahead"))).groupBy("s", "h").agg(F.max("dense").alias("dense"), F.max("ahead").alias("ahead"))
        marked = _matched(rows, marks, ["s", "h"], "left").fillna(False, ["dense", "ahead"])
        points = marked.filter("dense or ahead").groupBy("s", "h", "us", "cents").agg(F.count("*").alias("w"))
        found = _whole(marked, width, ~F.col("dense"), ~F.col("ahead")).unionByName(_sliced(marked.filter("dense").select(*rows.columns), points, dense, width, chunk_rows))
    c = F.col("cents")
    far = F.when(F.col("n") >= 2, 2 * F.abs(2 * c - F.col("median2")) > 3 * F.col("mad4"))
    return found.select(F.col("id").alias(id), F.col("s").alias(series), "n", "median2", "mad4", far.alias("far"))
