"""The queries of the operators on the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.llm import (
    exact_dedup,
    html_extract,
    langid,
    line_dedup,
    mixing,
    packing,
    periodic_runs,
    pii,
    secrets,
    simhash,
    topk,
    url_filter,
    vector_codes,
)
from dwellkit.llm.common import read, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def job(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return add


# ------------------------------------------------------------------ 1

@job("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, keep="max").select(
        "doc_id", F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"),
        F.lower(F.hex("_sha256")).alias("text_sha256"))


# ------------------------------------------------------------------ 2

@job("op2_html_extract")
def op2_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url", "html")
    weight = html_extract.fit(pages)
    text = pages.select("page_id", "url", html_extract.extract(weight).alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("bigint"))


# ------------------------------------------------------------------ 3

def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@job("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf, "documents"), tokenizer_path())
    return packed.select(F.col("doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# ------------------------------------------------------------------ 4

def held_out() -> F.Column:
    """Null identifiers count as the empty text here."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


@job("op4_language_id")
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out()))
    said = docs.select("doc_id", held_out().alias("held_out"), langid.predict(docs, model).alias("_said"))
    return said.select("doc_id", "held_out", F.col("_said.lang").alias("lang_pred"), F.col("_said.score").alias("score"))


# ------------------------------------------------------------------ 5

@job("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


# ------------------------------------------------------------------ 6

def _mix_sql() -> str:
    b, p, rounds = mixing.BLOCK, mixing.PRIME, mixing.ROUNDS
    w = mixing.WEIGHTS
    steps = []
    for r in range(1, rounds + 1):
        # The round's keys, the partner of i, and the bit of the larger of both.
        k = f"((key * 48271 + {r} * 69621 + 12345) % {p})"
        steps.append(f"k{r} AS (SELECT *, ({k} * ((key * 16807 + {r} * 40692 + 1) % {p})) % blocks AS c, "
                     f"({k} * {k} + {r}) % {p} AS m FROM i{r - 1})")
        steps.append(f"o{r} AS (SELECT *, ((c - i) % blocks + blocks) % blocks AS o FROM k{r})")
        steps.append(f"i{r} AS (SELECT source, pass, first_i, blocks, key, source_size, passes, rest, "
                     f"CASE WHEN ((greatest(i, o) % {p}) * m) % {p} > {p // 2} THEN o ELSE i END AS i FROM o{r})")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
    {float(mixing.MAX_REPEAT)} * source_size AS cap FROM sizes),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN {w[0]}.0 WHEN 1 THEN {w[1]}.0 ELSE {w[2]}.0 END::DOUBLE AS w FROM turns),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap::DOUBLE) OVER (ORDER BY cap / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM weighed),
water AS (SELECT arg_min(level, place) FILTER (cap > level * w) AS held FROM levels),
targets AS (SELECT source, source_size, rank,
    CASE WHEN held IS NULL OR cap <= held * w THEN cap::DOUBLE ELSE held * w END AS target FROM levels, water),
passes AS (SELECT *, CAST(ceil(source_size / {float(b)}) AS BIGINT) AS blocks,
    CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS passes FROM targets),
quotas AS (SELECT *, CAST(round(target - passes * source_size) AS BIGINT) AS rest FROM passes),
slots AS (SELECT *, unnest(generate_series(0, (passes + 1) * blocks - 1)) AS slot FROM quotas WHERE blocks > 0),
i0 AS (SELECT source, slot // blocks AS pass, slot % blocks AS first_i, blocks,
    (1 + rank * 1000003 + (slot // blocks) * 7919) % {p} AS key, source_size, passes, rest, slot % blocks AS i FROM slots),
{", ".join(steps)},
blocks AS (SELECT *, least({b}, source_size - i * {b}) AS full_words FROM i{rounds}),
drawn AS (SELECT source, i AS block, CASE WHEN pass < passes THEN full_words ELSE greatest(0, least(full_words, rest
    - coalesce(sum(full_words) OVER (PARTITION BY source, pass ORDER BY first_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS words
    FROM blocks),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM docs),
taken AS (SELECT rid, sum(greatest(0, least(start + size, block * {b} + words) - greatest(start, block * {b}))) AS taken
    FROM placed p JOIN drawn d ON p.source IS NOT DISTINCT FROM d.source
        AND start < block * {b} + words AND start + size > block * {b} GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN taken USING (rid) JOIN targets t ON p.source IS NOT DISTINCT FROM t.source"""


@job("op6_mix_sources", _mix_sql())
def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    sized = docs.select(F.col("doc_id").alias("id"), "source", mixing.n_words(text_or_empty()).alias("size"))
    return mixing.mix_counts(sized).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


# ------------------------------------------------------------------ 7

@job("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", secrets.find_secrets().alias("s")).select("doc_id", "s.*")


# ------------------------------------------------------------------ 8

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Host labels whose pages make up the list of blocked URLs of the query.
LISTED_LABELS = ["ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"]


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    labels = ", ".join(f"'{x}'" for x in LISTED_LABELS)
    return f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
urls AS (SELECT row_number() OVER () AS rid, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT rid, arg_max(rule_host || rule_path, length(rule_host || rule_path) * 10000 + length(rule_host)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path) * 10000 + length(rule_host)) AS rule_verdict
    FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(rule_verdict,
    CASE WHEN list_has_any(string_split(host, '.'), [{labels}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN best USING (rid)"""


@job("op8_url_filter", _url_sql())
def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    labels = F.array(*[F.lit(x) for x in LISTED_LABELS])
    listed = pages.filter(F.arrays_overlap(F.split(url_filter.host_of(F.col("url")), r"\."), labels)).select("url")
    return url_filter.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


# ------------------------------------------------------------------ 9

@job("op9_exact_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""")
def op9_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


# ------------------------------------------------------------------ 10

@job("op10_pii")
def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return pii.find_pii(docs).select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
                                     "base_sha256", "spans")


# ------------------------------------------------------------------ 11

def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        # Every part meets every entry; the least distance wins, ties the lower index.
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, p, q, min(d * {entries} + entry) % {entries} AS entry, min(d) AS d FROM
    (SELECT c.rid, c.vec_id, c.p, c.q, b.entry, CAST(list_sum(list_transform(list_zip(c.q, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS d
    FROM cut c JOIN b{r} b USING (p)) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM
    (SELECT p, entry, i, sum(x) AS s, count(*) AS n FROM (SELECT p, entry, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r})
    GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, entry))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT rid, vec_id, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS q
    FROM v, range({parts}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS entry, q AS c FROM cut WHERE rid <= {entries}),
{", ".join(steps)},
words AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT rid, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded USING (rid), words"""


@job("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    codes, books = vector_codes.encode(read(spark, sf, "embeddings"))
    code = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return codes.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error",
                        F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


# ------------------------------------------------------------------ 12

@job("op12_line_dedup", """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS found FROM documents),
lines AS (SELECT rid, doc_id, unnest(found) AS line, generate_subscripts(found, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
judged AS (SELECT k.*, r.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid""")
def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------------------ 13

def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: a tenth of the documents repeat a stretch of their own. A null id counts as empty."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    left = len(words) - a
    p = 1 + left // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-left // p))[:left]


@job("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    found = docs.select("doc_id", periodic_runs.periodic_runs(F.col("text"), F.col("doc_id"), planted).alias("r"))
    best = F.array_max(F.transform("r.runs", lambda x: F.struct(x.length.alias("length"), (-x.start).alias("s"), (-x.period).alias("p"))))
    lines = F.transform("r.runs", lambda x: F.concat_ws(",", x.start, x.length, F.concat(x.period.cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("r.runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("r.collapsed", 256).alias("collapsed_sha256"))
