"""Language, quality, toxicity, media and tokens: whole texts one by one."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from meridian.llm import bpe, common, langid, media, quality, toxicity
from meridian.llm.queries import QUERIES, tokenizer_path
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, score double, __x string"
ODD = ["", None, "   \t\n", "12345 !!", "the", "x" * 300_000, "Ünï çödé 漢字 🙂", "a\x00b", "<|endoftext|> it's  <|endoftext|>", "the and of " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, twice each, with nulls in all other columns and names that operators use themselves."""
    rows = [(i, t, None, None, 0.5, None) for i, t in enumerate(ODD)] * 2 + [(None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sample_is_bounded_and_keeps_rare_classes(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 5, "rare").otherwise("often").alias("c"), F.col("id").cast("string").alias("t"))
    n = {r[0]: r[1] for r in common.bounded_sample(rows, "c", 100, 1000, ["t"]).groupBy("c").count().collect()}
    assert n["rare"] == 5 and 50 < n["often"] < 200
    same = spark.range(5000).select(F.lit("c").alias("c"), F.lit("t").alias("t"))
    assert common.bounded_sample(same, "c", 100, 1000, ["t"]).count() <= 1


def test_language(docs, odd, spark):
    model = langid.fit(docs)
    got = langid.identify(odd, model, score="score")
    assert sorted(got.columns) == sorted(["doc_id", "text", "lang", "source", "__x", "lang_pred", "score"])
    rows = got.collect()
    assert len(rows) == 2 * len(ODD) + 1
    for r in rows:
        assert 0 <= r["score"] <= 1
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not lettered)
    assert langid.identify(docs.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0))
    assert none is None and {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    held = QUERIES["op2_language_id"](spark, SF).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.9 * held.count()


def test_language_of_long_text_is_counted_in_pieces():
    text = np.frombuffer(b"der die das und ein " * 150_000, np.uint8)
    whole = langid._counts(text, np.array([0, len(text)]))
    parts = langid.features(text, np.array([0, len(text)]))
    assert np.allclose(parts, np.sqrt(whole / whole.sum()))


def test_one_language_and_unknown_family():
    x = np.random.default_rng(0).random((20, langid.DIM)).astype(np.float32)
    m = langid.train(x, ["xx"] * 20)
    assert m.predict(x)[0].tolist() == [0] * 20 and np.allclose(m.predict(x)[1], 1)


def test_quality(docs, labels, odd, spark):
    model = quality.fit(docs, labels)
    rows = quality.rate(odd, model, score="score").collect()
    assert len(rows) == 2 * len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1
    nothing = quality.fit(docs, labels.limit(0))
    assert {r["quality_score"] for r in quality.rate(odd, nothing).collect()} == {0.5}
    conflicting = labels.limit(1).select("doc_id", F.lit(0).alias("quality"), "toxic").unionByName(labels.limit(1).select("doc_id", F.lit(1).alias("quality"), "toxic"))
    assert quality.labelled(docs, conflicting, "quality", 10, 1000).count() == 0


def test_quality_separates():
    good, bad = [f"the quick brown fox number {i} jumps over lazy dogs and sleeps. ".encode() * 8 for i in range(40)], [f"$$$ {i} ### %%% *** &&& @@@ !!! ".encode() * 12 for i in range(40)]
    m = quality.train(good + bad, [1] * 40 + [0] * 40)
    assert m.score(m.difference(good[3])) > 0.8 > 0.2 > m.score(m.difference(bad[3]))


def test_toxicity(docs, labels, odd):
    lang = langid.fit(docs)
    model = toxicity.fit(docs, labels, lang)
    rows = toxicity.rate(odd, model, score="score").collect()
    assert len(rows) == 2 * len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.fit(docs, labels.limit(0), lang) is None
    assert {r["toxic_score"] for r in toxicity.rate(odd, None).collect()} == {0.0}
    clean = toxicity.fit(docs, labels.filter("toxic = 0"), lang)
    assert max(r["toxic_score"] for r in toxicity.rate(odd, clean).collect()) < toxicity.CUT


def test_toxic_words_and_stems_are_learned():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, y = [], []
    for i in range(300):
        w = [word() for _ in range(30)]
        if i % 3 == 0:
            w[rng.integers(30)] = "zzvile" + word()[:2]
        texts.append(" ".join(w).encode())
        y.append(float(i % 3 == 0))
    ids = lambda t: toxicity.words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
    m = toxicity.train([ids(t) for t in texts], np.array(y))
    z = np.array([m.logits(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"abc zzvilexyz gh", b"abc dcba gh", b"")])
    assert z[0] > 0 > max(z[1:])


def test_toxicity_of_long_text_sees_over_cuts(monkeypatch):
    m = toxicity.train([np.zeros((3, toxicity.PARTS), np.int32), np.ones((3, toxicity.PARTS), np.int32)], np.array([1.0, 0.0]), epochs=2)
    text = np.frombuffer(b"some words here and there, again and again " * 50, np.uint8)
    at = np.array([0, len(text)])
    whole = m.logits(text, at)
    monkeypatch.setattr(toxicity, "PIECE", 200)
    assert np.allclose(m.logits(text, at), whole, atol=1e-4)


def test_tokens(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = bpe.encode(odd, bpe.Codec.load(tokenizer_path()), outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == 2 * len(ODD) + 1
    by = {i: r for r in rows if (i := r["doc_id"]) is not None}
    for i, text in enumerate(ODD):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert by[i]["ids"] == want and by[i]["n_tokens"] == len(want)
        assert by[i]["decoded"] == t.decode(want, skip_special_tokens=False) == (text or "")
        assert by[i]["ids_sha256"] == sha256(",".join(map(str, want)).encode()).hexdigest()
    assert bpe.encode(odd.limit(0), bpe.Codec.load(tokenizer_path())).count() == 0


def test_tokens_without_a_table(odd, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    codec = bpe.Codec.load(tokenizer_path())
    none = pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.string())})
    a = {r["doc_id"]: r["ids"] for r in bpe.encode(odd, codec, table=none).collect()}
    assert a == {r["doc_id"]: r["ids"] for r in bpe.encode(odd, codec).collect()}


def test_table_bound(odd):
    codec = bpe.Codec.load(tokenizer_path())
    assert 0 < bpe.encoded_words(bpe.distinct_words(odd), codec, most=5).num_rows <= 5


def rest_of(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_queries_of_scores_equal_plain_code(docs, labels, spark):
    """op2, op5 and op8 as queries: held-out rows, predictions and scores, against the model applied text by text."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    learn = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    lang = langid.fit(learn)
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    as_bytes = lambda t: (np.frombuffer(b := (t or "").encode(), np.uint8), np.array([0, len(b)]))
    for i, t in texts.items():
        best, sure = lang.predict(langid.features(*as_bytes(t)))
        lettered = t is not None and any(c.isalpha() for c in t)
        assert got[i]["held_out"] == (rest_of(i, 4) == 2) and got[i]["lang_pred"] == (lang.langs[best[0]] if lettered else "und")
        assert got[i]["score"] == pytest.approx(float(sure[0]) if lettered else 0.0, abs=1e-5)
    third = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = quality.fit(docs.filter(third), labels.filter(third))
    for r in QUERIES["op5_quality"](spark, SF).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        size = lambda d: sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(raw[i : i + quality.PIECE])) for i in range(0, len(raw), quality.PIECE))  # noqa: B023, E731
        good, bad = size(model.good), size(model.bad)
        score = 1 / (1 + np.exp(-(model.a * ((bad - good) / (bad + good) if raw else 0) + model.b)))
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (rest_of(r["doc_id"], 3) == 1)
    quarter = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    toxic = toxicity.fit(learn, labels.filter(quarter), lang)
    for r in QUERIES["op8_toxicity"](spark, SF).collect():
        data = as_bytes(texts[r["doc_id"]])
        by = np.array(lang.langs, object)[lang.predict(langid.features(*data))[0]]
        assert r["score"] == pytest.approx(float(toxic.score(toxic.logits(*data), by)[0]), abs=1e-3) and r["predicted"] == int(r["score"] >= toxicity.CUT) and r["held_out"] == (rest_of(r["doc_id"], 4) == 2)


def test_query_of_tokens_equals_the_library(docs, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in QUERIES["op10_bpe"](spark, SF).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_of_callers_and_empty_tables(docs, labels, spark):
    """Columns with names that operators once used themselves stay, and empty tables stay empty."""
    names = ["__text", "own_text", "own_lettered", "own_best", "__lang", "__score", "best", "pos"]
    lang, model = langid.fit(docs), quality.fit(docs, labels)
    toxic, codec = toxicity.fit(docs, labels, lang), bpe.Codec.load(tokenizer_path())
    some = docs.select("doc_id", "text", *[F.lit("mine").alias(n) for n in names])
    for rows in (some.limit(3), some.limit(0)):
        n = rows.count()
        for f in (lambda d: langid.identify(d, lang), lambda d: quality.rate(d, model), lambda d: toxicity.rate(d, toxic), lambda d: bpe.encode(d, codec)):
            got = f(rows)
            assert set(names) < set(got.columns) and got.count() == n
            assert all(r[c] == "mine" for r in got.collect() for c in names)


def brute_media(text):
    """All figures of a text, by plain code."""
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 if raw else 192)
    parts = [payload[i : i + media.PART] for i in range(0, len(payload), media.PART)]
    forms = [media.stored(p) for p in parts]
    x = np.frombuffer(payload, np.uint8).astype(float)
    feature = f"{len(x) // 192}x192;mean={x.mean():.4f};dev={x.std():.4f};hist={'/'.join(str(int(((x >= a) & (x < a + 32)).sum())) for a in range(0, 256, 32))}"
    return len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), sum(map(len, forms)), sha256(b"".join(forms)).hexdigest(), feature, list(range(0, 2 * len(parts), 2)), [f"part {i + 1} of {len(parts)}" for i in range(len(parts))]


FIGURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "positions", "captions")


def near_equal(a, b):
    """Figures are equal, means and deviations but for the last digit."""
    number = lambda f: [float(x) for x in f.replace("mean=", "").replace("dev=", "").replace("x192", "").split(";hist")[0].split(";")]
    return a[:5] == b[:5] and a[6:] == b[6:] and a[5].split("hist")[1] == b[5].split("hist")[1] and np.allclose(number(a[5]), number(b[5]), atol=2e-4)


def test_pictures_are_lossless():
    x = bytes(np.random.default_rng(1).integers(0, 256, 192 * 7).astype(np.uint8))
    form = media.stored(x)
    assert media.read_back(form) == x and form[:8] == b"\x89PNG\r\n\x1a\n"
    for bad in (b"", form[:-1], form[:-20], form[:60] + bytes([form[60] ^ 1]) + form[61:]):
        with pytest.raises((ValueError, zlib.error, IndexError, Exception)):
            media.read_back(bad)


def test_media(odd, spark):
    docs = odd.withColumn("payload", media.payload_of(F.col("text")))
    pages = docs.select(F.sha2("payload", 256).alias("page"), media.page_of(F.col("payload")).alias("html")).distinct()
    found = media.resolve(media.sequences(pages), media.store(docs))
    got = {r["page"]: tuple(r[f] for f in FIGURES) for r in media.reassembled(found, "page").collect()}
    want = {w[1]: w for w in map(brute_media, [*ODD, "no id"])}
    assert got.keys() == want.keys()
    for k in want:
        assert near_equal(got[k], want[k])
    assert media.store(docs).count() == len({p for t in [*ODD, "no id"] for p in (lambda b: [b[i : i + media.PART] for i in range(0, len(b), media.PART)])((t or "").encode() + b" " * (-len((t or "").encode()) % 192 if t else 192))})


def test_media_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_media_columns"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["n_bytes"] == len((docs[r["doc_id"]] or "").encode())
        assert near_equal(tuple(r[f] for f in FIGURES), brute_media(docs[r["doc_id"]]))


def test_media_of_nothing_and_of_lost_parts(spark, odd):
    docs = odd.limit(0).withColumn("payload", media.payload_of(F.col("text")))
    pages = docs.select("doc_id", media.page_of(F.col("payload")).alias("html"))
    assert media.store(docs).count() == 0 and media.sequences(pages).count() == 0
    found = media.resolve(media.sequences(pages), media.store(docs))
    assert found.count() == 0 and media.reassembled(found, "doc_id").count() == 0
    html = '<img src="sha256:aa"><img src="sha256:bb">'
    some = media.sequences(spark.createDataFrame([(1, html), (2, '<img src="sha256:aa">'), (None, '<img src="sha256:aa">'), (2, '<img src="sha256:aa">')], "id long, html string"))
    got = {r["id"]: r for r in media.reassembled(media.resolve(some, spark.createDataFrame([("aa", media.stored(b"a" * 192))], "digest string, media binary")), "id").collect()}
    assert got[1]["payload_bytes"] is None and got[1]["positions"] == [0, 1] and got[None]["payload_bytes"] is None
    assert got[2]["payload_bytes"] == 384  # the page is there twice: its pictures follow each other


def test_interleaved_order_and_captions(spark):
    html = '<p>one <b>two</b></p><figure><img src="sha256:aa" alt="old"><figcaption>a  caption</figcaption></figure>three<script>no</script><img data-digest="bb" alt="alt"><p>four'
    pages = spark.createDataFrame([(1, html, "u", 5), (2, None, None, None), (3, "", "u", 6), (3, "", "u", 6)], "page_id long, html string, caption string, pos int")
    s = media.sequences(pages)
    items = {r["page_id"]: r["items"] for r in s.collect()}
    assert [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in items[1]] == [("text", "one two", None), ("media", "aa", "a caption"), ("text", "three", None), ("media", "bb", "alt"), ("text", "four", None)]
    assert items[2] == items[3] == []
    found = media.resolve(s, spark.createDataFrame([("aa", b"x", 7), (None, b"y", 8)], "digest string, media binary, pos int"))
    assert found.columns == ["page_id", "page_caption", "page_pos", "pos", "caption", "digest", "media", "media_pos"]
    assert {(r["digest"], r["pos"], r["caption"], r["page_caption"], r["page_pos"], r["media_pos"]) for r in found.collect()} == {("aa", 1, "a caption", "u", 5, 7), ("bb", 3, "alt", "u", 5, None)}
    assert media.resolve(s, spark.createDataFrame([], "digest string, media binary")).filter("media is not null").count() == 0
