"""The queries of this subpackage: name to function, and name to DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import ann, bpe, collocations, langid, media, mixing, quality, repeats, rolling, simhash, tokencount, toxicity, urls
from meridian.llm.common import held, split_of, table

def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary: the one that op10 and the pipeline encode with, or another."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: op11: more tokens are over the limit.
TOKEN_LIMIT = 2048
#: Rules of op3: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]


def _learnable(docs: DataFrame, parts: int, out: int) -> DataFrame:
    """Rows that may be learned from: their split is known and is not the held-out one."""
    return docs.filter(split_of(F.col("doc_id"), parts) != out)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(_learnable(docs, 4, 2))
    rows = docs.select("doc_id", held(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return langid.identify(rows, model, score="score").drop("text")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, digests=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(_learnable(docs, 3, 1), _learnable(table(spark, sf_dir, "labels"), 3, 1))
    rows = docs.select("doc_id", held(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return quality.rate(rows, model, score="score").drop("text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), media.payload_of(text).alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("page")
    pages = docs.select(digest, media.page_of(F.col("payload")).alias("html")).dropDuplicates(["page"])
    items = media.sequences(pages).withColumn("pictures", F.size(F.filter("items", lambda x: x["kind"] == "media")))
    figures = media.reassembled(media.resolve(items, media.store(docs)), "page", pictures="pictures")
    return docs.select("doc_id", "n_bytes", digest).join(figures, "page").drop("page")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = _learnable(docs, 4, 2)
    model = toxicity.fit(learn, _learnable(table(spark, sf_dir, "labels"), 4, 2), langid.fit(learn))
    rows = docs.select("doc_id", held(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return toxicity.rate(rows, model, score="score").drop("text").withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, bpe.Codec.load(tokenizer_path()), outputs=("ids_sha256", "decoded_sha256")).drop("text")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokencount.Counter.load(tokenizer_path("word_bpe_49k.json"))).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), best=2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_quality": op5_quality,
    "op6_media_columns": op6_media_columns,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_bpe": op10_bpe,
    "op11_token_counts": op11_token_counts,
    "op12_collocations": op12_collocations,
    "op13_rolling_median": op13_rolling_median,
}

OP3_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
)
SELECT page_id, host, path,
  (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT max_by(rverdict, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM parsed
"""

OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS w
  FROM docs GROUP BY source
), filled AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS heavy
  FROM sources WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT min_by({'rest': rest, 'heavy': heavy}, 2.0::DOUBLE * source_size / w) AS cut FROM filled WHERE 2.0::DOUBLE * source_size * heavy > rest * w
), goals AS (
  SELECT source, source_size, CASE WHEN 2.0::DOUBLE * source_size * heavy <= rest * w THEN 2.0::DOUBLE * source_size
    ELSE w * (SELECT cut.rest FROM level) / (SELECT cut.heavy FROM level)::DOUBLE END AS target
  FROM filled
), copies AS (
  SELECT source, c, least(greatest(target - (c - 1) * source_size, 0), source_size::DOUBLE) AS budget FROM goals, (VALUES (1), (2)) t(c)
), ties AS (
  SELECT source, h, sum(size) AS words FROM docs GROUP BY source, h
), sums AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM ties
), taken AS (
  SELECT s.source, s.h, count(*) FILTER (WHERE budget > 0 AND (upto <= budget OR (upto - words <= budget AND upto - budget < budget - (upto - words)))) AS n
  FROM sums s JOIN copies k ON s.source IS NOT DISTINCT FROM k.source GROUP BY s.source, s.h
)
SELECT d.doc_id, d.size, g.source_size, g.target, (d.size * t.n)::BIGINT AS taken
FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source JOIN taken t ON d.source IS NOT DISTINCT FROM t.source AND d.h = t.h
"""

OP12_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM texts
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, w, i, unnest(range(1, 6)) AS k FROM starts
), f AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*)::BIGINT AS a FROM grams WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), candidates AS (
  SELECT * FROM f WHERE k >= 2 AND a >= 100
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.a >= 100 * c.a)
), cuts AS (
  SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM kept
), scores AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, cut, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 :], ' ')
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""

OP13_SQL = r"""
WITH once AS (
  SELECT DISTINCT click_id, ts, kind, floor(100 * value + 0.5)::BIGINT AS c FROM clicks WHERE ts IS NOT NULL
), held AS (
  SELECT click_id, kind, c, list_sort(coalesce(list(c) FILTER (WHERE c IS NOT NULL) OVER (
    PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW), [])) AS w
  FROM once
), middles AS (
  SELECT *, CASE WHEN len(w) >= 2 THEN w[(len(w) + 1) // 2] + w[len(w) // 2 + 1] END AS median2 FROM held
), spreads AS (
  SELECT *, list_sort(list_transform(w, lambda x: abs(2 * x - median2))) AS d FROM middles
), made AS (
  SELECT *, CASE WHEN len(w) >= 2 THEN d[(len(w) + 1) // 2] + d[len(w) // 2 + 1] END AS mad4 FROM spreads
)
SELECT click_id, kind, len(w)::BIGINT AS n, median2, mad4, 2 * abs(2 * c - median2) > 3 * mad4 AS far FROM made
"""

SQL = {"op3_url_filters": OP3_SQL, "op9_mixing": OP9_SQL, "op12_collocations": OP12_SQL, "op13_rolling_median": OP13_SQL}
