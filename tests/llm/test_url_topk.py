"""URL rules and exact top-k against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellkit.llm import topk, url_filter

URLS = ["http://example.org/es/1", "https://WWW.Example.ORG/en/15?x=/es/", "ftp://a.b.example.org/en/2#/es/", "http://example.org", "http://notexample.org/es/",
        "http://x.com/fr/", "http://com/de/x", "http://x.com/DE/", "nothing", None, "", "://h/p", "http://a.org/q\nr?z", "http://org./x", "a://b://c/d",
        "http://casino.net/bad", "https://casino.net/bad?again", "http://casino.net/bad/er", "http://é.net/bad", "http://user:pw@h.org:80/en/1"]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("org", "/", "allow"), (None, "/x", "block"), ("b.example.org", "", "block")]
LISTED = ["http://CASINO.net/bad?q", None, "no url", "https://é.net/bad"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[:min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]


def verdict(url, rules, listed):
    host, path = parts(url)
    fits = [] if url is None or "://" not in url else [
        (len(h + p), len(h), h + p, v) for h, p, v in rules if h is not None and p is not None
        and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, _, rule, said = max(fits)
        return host, path, rule, said
    forms = {"".join(parts(x)) for x in listed if x is not None and "://" in x}
    hit = url is not None and "://" in url and host + path in forms
    return host, path, None, "block" if hit else "allow"


@pytest.mark.parametrize("blocks", [1, 1 << 17])
def test_verdicts_by_brute_force(spark, blocks):
    rows = [(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    got = url_filter.judge(pages, rules, listed, max_blocks=blocks).collect()
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got) == \
        sorted((str(i), *(str(x) if n == 2 else x for n, x in enumerate(verdict(u, RULES, LISTED)))) for i, u, _ in rows)


def test_clashing_columns_stay(spark):
    names = ["_url", "_b", "_row", "key", "kind", "verdict"]
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string").select("*", *[F.lit("x").alias(c) for c in names])
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules, spark.createDataFrame([(u,) for u in LISTED], "url string"))
    assert got.columns == ["page_id", "url", *names[:-1], "host", "path", "rule", "verdict"]
    row = got.first()
    assert [row[c] for c in names[:-1]] == ["x"] * 5 and row["verdict"] == verdict(URLS[0], RULES, LISTED)[3]


def test_no_rules_no_list_no_pages(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    listed = spark.createDataFrame([], "url string")
    assert [r["verdict"] for r in url_filter.judge(pages, rules, listed).collect()] == ["allow"]
    assert url_filter.judge(pages.filter("false"), rules, listed).count() == 0


def test_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    other = spark.range(20000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert url_filter.possible(keys, keys).count() == 4000
    assert url_filter.possible(other, keys).count() < 1000
    assert url_filter.possible(other, keys, max_blocks=1).count() <= 20000


# ------------------------------------------------------------------ top-k

def brute(rows, queries, k, scale=64):
    def q(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            return None
        return [int(np.floor(scale * float(x))) for x in v]
    ready = [(i, q(v)) for i, v in rows if i is not None and q(v) is not None]
    out = []
    for qi, qv in {(i, tuple(q(v))) for i, v in queries if i is not None and q(v) is not None}:
        hits = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ready if i != qi and len(v) == len(qv))[:k]
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("seed,n,d,size,k", [(0, 150, 5, 1 << 22, 20), (1, 300, 8, 400, 7), (2, 40, 1, 1 << 22, 50), (3, 130, 64, 4000, 3)])
def test_top_k_by_brute_force(spark, seed, n, d, size, k):
    rng = random.Random(seed)
    values = [-0.02, 0.0, 0.5, 1.0, -1.0] if seed == 0 else None
    rows = [(i, [float(np.float32(rng.choice(values) if values else rng.gauss(0, 0.4))) for _ in range(d)]) for i in range(n)]
    rows += [(n, None), (n + 1, [None] + [0.0] * (d - 1)), (n + 2, [float("nan")] + [0.0] * (d - 1)), (n + 3, [float("inf")] * d), (n + 4, []),
             (n + 5, [1.0] * (d + 1)), (3, rows[3][1]), (3, rows[4][1]), (None, [1.0] * d)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = topk.top_k(df, df.filter("vec_id % 20 = 0 OR vec_id = 3"), k=k, block_values=size).collect()
    want = brute(rows, [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] == 3)], k)
    if seed:
        assert sorted(map(tuple, got)) == want
    else:
        assert sorted((r[0], r[1], r[2], r[3]) for r in got) == want


def test_scores_are_sums_of_bitmaps():
    rng = np.random.default_rng(4)
    block = topk.SlicedBlock(np.arange(200), rng.integers(-50, 50, (200, 9)))
    query = rng.integers(-40, 40, 9)
    planes = block.scores(query)
    bits = np.array([np.unpackbits(p.view(np.uint8), bitorder="little")[:200] for p in planes], dtype=np.int64)
    total = (bits << np.arange(len(planes))[:, None]).sum(0)
    exact = block.values @ query
    assert len(set((total - exact).tolist())) == 1


def test_top_k_without_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


def test_large_components_keep_their_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60, [2000000.0, 1.0, 0.0, -1.0]), (61, [-3e15, 0.5, 0.25, 2.0]), (62, [1e300, 0.0, 0.0, 0.0]), (80, [0.0, 4e6, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # Of these queries none has a score beyond a long.
    asked = [(100, [0.0, 1.0, 0.5, 2.0]), (120, [1.0, 0.0, 0.0, 0.0]), (140, [0.0, 0.0, 5e6, 0.25])]
    queries = spark.createDataFrame(asked[:1] + asked[2:], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, queries, k=70).collect()))
    assert got == brute(rows, asked[:1] + asked[2:], 70) and len(got) == 2 * len(rows)
    with pytest.raises(Exception):
        topk.top_k(df, spark.createDataFrame(asked[1:2], "vec_id long, embedding array<double>"), k=70).collect()


def test_an_id_on_many_rows_is_dealt_over_blocks(spark):
    rows = [(7, [float(i % 3), 1.0]) for i in range(300)] + [(i, [0.5, float(i)]) for i in range(20, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id = 20"), k=400, block_values=40).collect()))
    assert got == brute(rows, [r for r in rows if r[0] == 20], 400)
