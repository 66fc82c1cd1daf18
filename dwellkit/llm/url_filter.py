"""URL rules and block lists behind a blocked Bloom filter.

Listed canonical URLs (host and path) are hashed into blocks of eight 32-bit words, one bit in
each. A URL's own canonical form and the prefixes that a rule may name are tested against
that filter, and only possible hits go on to the exact join, which removes false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.session import materialized

#: Eight odd multipliers, one for each word of a block.
SALTS = tuple((2 * i + 1) * 0x9E3779B1 % 2 ** 31 | 1 for i in range(3, 11))
MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 16


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1),
                                  "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    low = F.pmod(h, F.lit(2 ** 31)).cast("bigint")
    bits = [F.pmod(F.shiftright(low * salt, 20), F.lit(32)).cast("int") for salt in SALTS]
    return F.pmod(F.shiftright(h, 31), F.lit(blocks)).cast("int"), bits


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def build(keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of the column ``key``: (block, word0 .. word7), and its number of blocks.

    It has a block for each 16 keys, but never more than ``max_blocks``, so it fits a broadcast
    whatever the list's size; a fuller filter lets more pass to the exact join, never less.
    """
    n = keys.count()
    blocks = max(1, min(max_blocks, -(-n // KEYS_PER_BLOCK)))
    block, bits = _place(F.col("key"), blocks)
    words = [F.bit_or(_bit(b)).alias(f"word{i}") for i, b in enumerate(bits)]
    return keys.groupBy(block.alias("_block")).agg(*words), blocks


def possible(rows: DataFrame, keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows whose column ``key`` may be among ``keys``: all that are, and a few more."""
    table, blocks = build(keys, max_blocks)
    block, bits = _place(F.col("key"), blocks)
    there = reduce(lambda a, b: a & b, [F.col(f"word{i}").bitwiseAND(_bit(b)) != 0 for i, b in enumerate(bits)])
    return (rows.withColumn("_at", block).join(F.broadcast(table), F.col("_at") == F.col("_block"))
            .filter(there).select(*rows.columns))


def candidates(urls: DataFrame, path_lengths: list[int], label_counts: list[int]) -> DataFrame:
    """(url, key, kind): the canonical form of each URL, and each host suffix with each path prefix.

    Only suffixes of as many labels and prefixes of as many characters as some rule has are
    made, so a URL of any length gives counts x lengths rows at most.
    """
    labels = F.split("host", r"\.")
    hosts = F.array_compact(F.array(*[
        F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - (n - 1), F.lit(n)), ".")) for n in label_counts]))
    paths = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in path_lengths]))
    rules = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(
        F.concat(h, p).alias("key"), F.lit("rule").alias("kind")))))
    own = F.array(F.struct(F.concat("host", "path").alias("key"), F.lit("listed").alias("kind")))
    return urls.select("url", F.explode(F.concat(own, rules) if path_lengths else own).alias("_c")).select("url", "_c.*")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url",
          max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Columns of ``pages`` plus host, path, rule and verdict.

    ``rules``: host, path, verdict; a rule fits its host and all subdomains if the URL's path
    begins with the rule's, and the longest (host and path together) wins, of equally long ones the one
    with the longer host. ``listed``: one column url. Without a rule a URL is blocked if its
    canonical form (host and path) is that of a listed one, else allowed. A null URL, or one
    without ``://``, has an empty host and path, and no rule or listed URL fits it. Repeated
    pages give repeated rows. Rules and lists may be empty or hold nulls, which fit nothing. Columns of ``pages``
    named host, path, rule or verdict are replaced; all others stay, whatever their names.
    """
    # A verdict depends on the URL alone, so each is judged once, however many rows share it.
    urls = pages.select(F.col(url_col).alias("url")).distinct().filter(F.col("url").contains("://"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    exact_rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        F.concat("host", "path").alias("key"), F.lit("rule").alias("kind"), F.col("verdict").alias("_verdict"),
        F.char_length("host").alias("_reach"))
    # Equal rules count once; the host's end is part of the exact comparison below.
    exact_rules = exact_rules.groupBy("key", "kind", "_reach").agg(F.min("_verdict").alias("_verdict"))
    form = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    exact_listed = listed.filter(F.col("url").contains("://")).select(
        form.alias("key"), F.lit("listed").alias("kind"), F.lit("block").alias("_verdict"),
        F.lit(-1).alias("_reach")).distinct()
    exact = materialized(exact_rules.unionByName(exact_listed))
    # Two short lists of small numbers: how long the rules' paths are, and how many labels their hosts have.
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL")
    lengths = sorted(r[0] for r in known.select(F.char_length("path")).distinct().collect())
    counts = sorted(r[0] for r in known.select(F.size(F.split("host", r"\."))).distinct().collect())
    hits = possible(candidates(urls, lengths, counts), exact.select("key").distinct(), max_blocks)
    found = hits.withColumnsRenamed({"key": "_k", "kind": "_kind"}).join(
        exact.hint("shuffle_hash"), (F.col("_k") == F.col("key")) & (F.col("_kind") == F.col("kind")))
    best = found.groupBy("url").agg(F.max(F.struct(
        (F.col("kind") == "rule").alias("is_rule"), F.char_length("key").alias("n"), F.col("_reach").alias("reach"),
        F.col("key").alias("key"), F.col("_verdict").alias("verdict"))).alias("_b")).withColumnRenamed("url", "_url")
    # One column, so that no name of the pages meets one of the join's.
    out = pages.select(F.struct("*").alias("_row")).join(best, F.col("_row")[url_col] == F.col("_url"), "left")
    url = F.col("_row")[url_col]
    return out.select(
        *[F.col("_row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
        host_of(url).alias("host"), path_of(url).alias("path"),
        F.when(F.col("_b.is_rule"), F.col("_b.key")).alias("rule"),
        F.coalesce(F.col("_b.verdict"), F.lit("allow")).alias("verdict"))
