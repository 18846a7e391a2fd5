"""Token counts, collocations and rolling medians against plain code."""

import bisect
import datetime as dt
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridian.llm import collocations, queries, rolling, tokencount
from tests.conftest import SF

WORD_BPE = queries.tokenizer_path("word_bpe_49k.json")
COUNTER, LIBRARY = tokencount.Counter.load(WORD_BPE).open(), Tokenizer.from_file(WORD_BPE)


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


# --- token counts


def odd_texts():
    rng = np.random.default_rng(0)
    letters = lambda n: "".join(chr(int(c)) for c in rng.integers(97, 123, n))
    makers = [
        letters, lambda n: " ".join(letters(int(rng.integers(1, 9))) for _ in range(n // 5)), lambda n: "it's they're <|startoftext|> !!'s'll 12 İ ß ΑΣ " * (n // 40),
        lambda n: "".join("ẹ́à한한"[int(i)] for i in rng.integers(0, 8, n)), lambda n: "".join("😀🇩漢字!,"[int(i)] for i in rng.integers(0, 6, n)),
        lambda n: "a" * n, lambda n: "'" * n + "s", lambda n: "haha" * (n // 4), lambda n: "́" * n,
    ]
    mixed = " ".join(makers[int(rng.integers(0, 9))](60) for _ in range(60))
    return [None, "", " ", "x", *[m(n) for m in makers for n in (10, 130, 500, 3000)], "<|endoftext|>" * 300, mixed]


def test_words_are_counted_as_the_library_does():
    """Every character that the short way takes, and the check of the file that allows it."""
    assert COUNTER.by_words and COUNTER.ranked
    for c in map(chr, range(0x240)):
        for text in (c, f"a{c}b{c}{c} x", f"'{c}'s{c.upper()}'ll"):
            if max(text) < "ɀ":
                assert COUNTER.count(text, True) == count(text), repr(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(128, 64), (400, 100), (32_768, 512)])
def test_token_counts_of_odd_texts(spark, chunk, overlap):
    texts = odd_texts()
    df = spark.createDataFrame([*[(i, t, "own") for i, t in enumerate(texts)], (1000, texts[10], "copy"), (1000, texts[10], "copy")], "doc_id long, text string, key string")
    got = tokencount.count_tokens(df, COUNTER, chunk=chunk, overlap=overlap).collect()
    assert Counter((r["doc_id"], r["key"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter((i, k, len((t or "").encode()), count(t)) for i, t, k in df.collect())


def test_neighbours_without_a_common_token_are_widened(spark):
    """Long runs of one letter: their tokens lie differently in each chunk, so chunks of 700 find no common token and the text is cut anew."""
    df = spark.createDataFrame([("k", "b" + "a" * 5000 + "c")], "key string, text string")
    shared = spark.sparkContext.broadcast(COUNTER)
    made = tokencount._spliced(tokencount._chunked(df, shared, 701, 64), shared).collect()
    assert [r["ok"] for r in made] == [False]
    got = tokencount.huge_counts(df, COUNTER, 701, 64).collect()
    assert [(r["key"], r["n_tokens"]) for r in got] == [("k", count("b" + "a" * 5000 + "c"))]


def test_no_common_token_is_no_splice():
    one = np.array([[0, 2, 7, 0, 1], [2, 5, 8, 1, 0]], np.int64)
    two = np.array([[1, 2, 9, 0, 1], [2, 4, 8, 1, 0]], np.int64)
    assert tokencount.splice(one.tobytes(), two.tobytes()) is None
    assert tokencount.splice(b"", two.tobytes()) is None
    assert tokencount.splice(one.tobytes(), one.tobytes()) is not None
    assert tokencount.splice(one.tobytes(), one.tobytes(), ranked=False) == (0, 0)  # only where a word begins


def test_merges_out_of_order_are_noticed():
    assert tokencount._ranked([["a", "b"], ["ab", "c"]]) and not tokencount._ranked([["ab", "c"], ["a", "b"]])
    assert not tokencount._ranked([["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]])


def test_token_counts_of_the_table(spark):
    got = {r["doc_id"]: r for r in queries.op11_token_counts(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = count(r["text"])
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 2048)
    empty = tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string, N_Tokens int"), COUNTER)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens"]


# --- collocations


def brute_phrases(docs, least, best, most=5):
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in docs:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    for lang, g in f.items():
        c, inside = {p: a for p, a in g.items() if a >= least and len(p) > 1}, Counter()
        for p, a in c.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in c.items():
            if inside[p] < a:
                score, _, l, r = min((1000 * a * n[lang] // (g[p[:k]] * g[p[k:]]), k, g[p[:k]], g[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


PHRASE_COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("least", "best"), [(1, 2000), (5, 20), (30, 1000)])
def test_collocations_equal_brute_force(spark, least, best):
    rng, v = np.random.default_rng(1), ["a", "b", "New", "york", "city", "ça", "x_y", "of", "the", "é", " "]
    docs = []
    for i in range(200):
        words = [v[int(j)] for j in rng.integers(0, len(v), int(rng.integers(0, 60)))]
        text = "".join(x + [" ", "  ", "\t", ", ", ".", "\n"][int(rng.choice(6, p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]))] for x in words)
        docs.append((text + " New York city of the a" * (i % 4 == 0), ["en", "de", None][i % 3]))
    docs += [(None, "en"), ("", None), (" . ,", "fr"), ("one", "it"), ("Q R " * 5000, "en"), ("Q R " * 5000, "en"), ("", "")]
    df = spark.createDataFrame([(*d, "clash", 7) for d in docs], "text string, lang string, phrase string, n int").repartition(3)
    got = collocations.collocations(df, least=least, best=best).select(PHRASE_COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(docs, least, best)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string"), best=5).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), least=1, best=5).count() == 0


def test_a_full_table_of_hashes_only_lets_more_be_counted(spark):
    docs = [("a b c d. a b c. x y a b", "en")] * 10
    df = spark.createDataFrame(docs, "text string, lang string")
    got = collocations.collocations(df, least=10, best=100, table_bits=3).select(PHRASE_COLUMNS).collect()  # eight bits: nearly all are set
    assert sorted(tuple(r) for r in got) == brute_phrases(docs, 10, 100)


def test_scores_beyond_64_bits(spark):
    counted = spark.createDataFrame([("en", "a", 1, 10**12), ("en", "b", 1, 10**12), ("en", "a b", 2, 10**12)], "lang string, phrase string, k int, n long")
    r = collocations._scored(counted, spark.createDataFrame([("en", 9 * 10**12)], "lang string, n long")).first()
    assert r["score"] == 1000 * 10**12 * 9 * 10**12 // 10**24


# --- rolling medians


def brute_windows(rows, minutes=60):
    once, series, out = {}, defaultdict(list), {}
    for i, t, k, v in rows:
        if t is not None:
            once[i] = (t, k, None if v is None or v != v or abs(100 * v) >= rolling.MOST_CENTS else int(np.floor(100 * v + 0.5)))
    for i, (t, k, c) in once.items():
        series[k].append((t, i, c))
    for k, all_of in series.items():
        all_of.sort(key=lambda x: x[0])
        times = [x[0] for x in all_of]
        for t, i, c in all_of:
            w = sorted(x[2] for x in all_of[bisect.bisect_left(times, t - dt.timedelta(minutes=minutes)) : bisect.bisect_right(times, t)] if x[2] is not None)
            n = len(w)
            if n < 2:
                out[i] = (k, n, None, None, None)
                continue
            m = w[(n - 1) // 2] + w[n // 2]
            d = sorted(abs(2 * x - m) for x in w)
            mad = d[(n - 1) // 2] + d[n // 2]
            out[i] = (k, n, m, mad, None if c is None else 2 * abs(2 * c - m) > 3 * mad)
    return out


def odd_clicks():
    rng, base = np.random.default_rng(0), dt.datetime(2024, 3, 10, 1, 0)
    rows = []
    for i in range(2000):
        t = base + dt.timedelta(microseconds=int(rng.integers(0, 5 * 3600 * 10**6)) if i % 3 else int(rng.integers(0, 50)) * 360_000_000)
        t = base + dt.timedelta(minutes=90) if i % 7 == 0 else t
        rows.append((i, t, [None, "a", "b"][i % 3 if i % 5 else 1], None if i % 11 == 0 else round(float(rng.normal(0, 50)), 2) if i % 2 else float(rng.integers(-3, 4))))
    rows += rows[:100] + [(None, base, "a", 1.0), (9000, None, "a", 1.0), (9004, base, "big", 1e15), (9005, base, "big", -1e15), (9006, base, "big", 0.0)]
    return rows + [(9010 + i, base, "nan", v) for i, v in enumerate([float("nan"), float("inf"), -float("inf"), 1e300])] + [(9020, dt.datetime(1969, 12, 31, 23, 59, 59, 999999), "old", 1.0), (9021, dt.datetime(1970, 1, 1, 0, 59, 59, 999999), "old", 2.0), (9022, dt.datetime(1970, 1, 1, 1, 0), "old", 3.0)]


CLICKS = "click_id long, ts timestamp_ntz, kind string, value double"


@pytest.mark.parametrize("chunk_rows", [50_000, 1500, 100, 7])
def test_rolling_equals_brute_force(spark, chunk_rows):
    """In whole chunks, and in slices of dense ones."""
    rows = odd_clicks()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], CLICKS + ", h int, s string").repartition(3)
    got = rolling.rolling(df, chunk_rows=chunk_rows).collect()
    want = brute_windows(rows)
    assert len(got) == len(want)
    assert {r["click_id"]: (r["kind"], r["n"], r["median2"], r["mad4"], r["far"]) for r in got} == want


def test_rolling_does_not_depend_on_the_zone(spark):
    """Times without a zone, over an hour that a zone skips and one that it repeats."""
    times = [dt.datetime(2024, m, d, h, 30) for m, d in ((3, 10), (11, 3)) for h in range(6)]
    rows = [(i, t, "a", float(i)) for i, t in enumerate(times)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r["click_id"]: r["n"] for r in rolling.rolling(spark.createDataFrame(rows, CLICKS)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {i: v[1] for i, v in brute_windows(rows).items()}


def test_rolling_of_nothing(spark):
    assert rolling.rolling(spark.createDataFrame([], CLICKS)).count() == 0
    assert rolling.rolling(spark.createDataFrame([(1, None, "a", 1.0)], CLICKS)).count() == 0


def test_slices_hold_few_rows(spark):
    """A third of the rows at one instant, the rest within seconds: no task has more than a slice of points and the histogram."""
    rows = spark.range(60_000).select(F.col("id").alias("click_id"), F.when(F.col("id") % 3 == 0, F.lit("2024-01-01 00:30:00")).otherwise(F.expr("concat('2024-01-01 00:30:', lpad(cast(id % 60 as string), 2, '0'), '.', lpad(cast(id * 7919 % 1000000 as string), 6, '0'))")).cast("timestamp_ntz").alias("ts"), F.lit("a").alias("kind"), (F.col("id") % 97).cast("double").alias("value"))
    got = rolling.rolling(rows, chunk_rows=2000)
    whole = rolling.rolling(rows)
    key = ["click_id", "kind", "n", "median2", "mad4", "far"]
    assert got.select(key).exceptAll(whole.select(key)).isEmpty() and got.count() == 60_000
