"""Mixing sources to target weights by fixed-length blocks.

The words of a source stand one after the other (in an order fixed by a hash of the document)
and are cut into blocks of ``block`` words. Output slots are dealt to sources by a random
permutation of all slots: the counts of an output shard are then a multinomial draw that is
conditioned on the totals, so every source meets its target instead of scattering around it.
A slot's place among its source's slots goes through a pseudorandom permutation of the
source's block indices, one per pass over the source, and slots join blocks by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.llm.common import text_or_empty, width
from dwellkit.session import materialized

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 512
SHARD_SLOTS = 8192
ROUNDS = 24
PRIME = 2147483647
MAX_REPEAT = 3
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target: shares of the total by weight, none above its limit.

    ``sizes`` has one row per source. Sources in order of name (null last) take the weights in
    turn. A source's limit is ``max_repeat`` times its size; what is beyond goes to the others by
    weight until none is above. In order of limit per weight this is one running sum: the
    level of the water is set by the sources before that are full. One row per source meets in
    the windows here, never one per document.
    """
    one = W.partitionBy(F.lit(0))
    turn = F.pmod(F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    rows = rows.withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
    fill = one.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, W.unboundedFollowing)
    level = ((F.sum("source_size").over(one).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("_w").over(rest))
    rows = rows.withColumn("_level", level)
    # The level falls or stays until the first source that is not full; from there on it holds.
    rows = rows.withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_w"))
    held = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        fill.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("source", "source_size",
                       F.when(held.isNull(), F.col("_cap")).otherwise(held * F.col("_w")).alias("target"))


def round_keys(n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """For each round of ``permuted`` its centre below n and its multiplier, from a key below PRIME."""
    def one(r):
        k = F.pmod(key * 48271 + r * 69621 + 12345, F.lit(PRIME))
        return F.struct(F.pmod(k * F.pmod(key * 16807 + r * 40692 + 1, F.lit(PRIME)), F.greatest(n, F.lit(1))).alias("c"),
                        F.pmod(k * k + r, F.lit(PRIME)).alias("m"))
    return F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(rounds).cast("bigint")), one)


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 by the swap-or-not shuffle, for any n.

    Each round pairs i with (c - i) mod n and swaps the pair if a bit of the pair's larger
    member says so; both members see the same bit, so the round is its own inverse, and the
    keys in reverse order give the inverse permutation. All of it is plain arithmetic on
    longs: sums stay below 2 n and products below PRIME squared.
    """
    def round_(i, k):
        other = F.pmod(k["c"] - i, n)
        bit = F.pmod(F.pmod(F.greatest(i, other), F.lit(PRIME)) * k["m"], F.lit(PRIME)) > PRIME // 2
        return F.when(bit, other).otherwise(i)
    return F.aggregate(keys, index, round_)


def pass_key(seed: int, number: Column) -> Column:
    return F.pmod(F.lit(seed) + F.col("rank") * 1000003 + number * 7919, F.lit(PRIME))


def layout(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes, place of the first word per document; words per source), from id, source, size.

    Documents stand in a source by the MD5 of their identifier. The order is cut into ranges:
    range totals are summed first, and only the rows of one range and source meet in a
    window, so a source with a third of all rows is spread.
    """
    ranges = 4 * width(docs)
    hashed = docs.withColumn("_hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    hashed = hashed.withColumn("_range", F.floor(F.conv(F.substring("_hash", 1, 6), 16, 10).cast("bigint") * ranges / 2 ** 24))
    hashed = materialized(hashed)
    totals = hashed.groupBy("source", "_range").agg(F.sum("size").alias("_t"))
    earlier = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_s"), F.col("_range").alias("_r"),
                            F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_offset"))
    inside = (W.partitionBy("source", "_range").orderBy("_hash", "id", "size")
              .rowsBetween(W.unboundedPreceding, -1))
    placed = (hashed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
              .withColumn("start", F.col("_offset") + F.col("_in"))
              .drop("_s", "_r", "_offset", "_in", "_range", "_hash"))
    return placed, totals.groupBy("source").agg(F.sum("_t").alias("source_size"))


def quotas(sizes: DataFrame, block: int = BLOCK, seed: int = 1, weights=WEIGHTS,
           max_repeat: int = MAX_REPEAT) -> DataFrame:
    """targets() plus, per source: its blocks, whole passes, and slots and words of the last, partial pass.

    The last slot of the partial pass is cut so that the words add up to the target. A source's
    last block may be shorter; the inverse permutation tells whether the partial pass meets it.
    """
    t = targets(sizes, weights, max_repeat)
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    t = t.withColumns({"blocks": F.ceil(F.col("source_size") / F.lit(block)), "passes": whole.cast("bigint")})
    t = t.withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("bigint"))
    order = W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    t = t.withColumns({"rank": F.row_number().over(order).cast("bigint"),
                       "short": F.col("blocks") * block - F.col("source_size")})
    t = t.withColumn("keys", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(max_repeat).cast("bigint")),
                                         lambda p: round_keys(F.col("blocks"), pass_key(seed, p))))
    last_keys = F.reverse(F.get("keys", F.col("passes").cast("int")))
    short_at = F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.col("blocks"), last_keys))
    t = t.withColumn("short_at", F.coalesce(short_at, F.lit(0)))
    least = F.ceil(F.col("rest") / F.lit(block))
    one_more = (least * block - F.when(F.col("short_at") < least, F.col("short")).otherwise(0)) < F.col("rest")
    t = t.withColumn("rest_slots", least + one_more.cast("bigint"))
    t = t.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("rest_slots"))
    return t.withColumns({
        "slots_before": F.coalesce(F.sum("slots").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "all_slots": F.sum("slots").over(W.partitionBy(F.lit(0)))})


def draw(quota: DataFrame, block: int = BLOCK, seed: int = 1, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: one row per output slot, with shard, slot, source, pass, block, words and cut.

    ``words`` counts from the block's first word; ``cut`` tells a slot that does not take its
    whole block. All rows come from the seed and the totals, so reruns agree.
    """
    chunk = 4096
    chunks = quota.filter("slots > 0").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / chunk))))
    chunks = chunks.repartition(width(quota), "rank", "_chunk")
    slots = chunks.withColumn("_k", F.explode(F.sequence(
        F.col("_chunk") * chunk, F.least(F.col("_chunk") * chunk + chunk, F.col("slots")) - 1)))
    slots = slots.withColumns({"pass": F.floor(F.col("_k") / F.col("blocks")), "_i": F.col("_k") % F.col("blocks")})
    slots = slots.withColumns({
        # Never null, which saves the join a test that would compute it twice.
        "block": F.coalesce(permuted(F.col("_i"), F.col("blocks"), F.get("keys", F.col("pass").cast("int"))), F.lit(0)),
        "_place": permuted(F.col("slots_before") + F.col("_k"), F.col("all_slots"),
                           round_keys(F.col("all_slots"), F.lit(seed).cast("bigint")))})
    full = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.when((F.col("pass") == F.col("passes")) & (F.col("_i") == F.col("rest_slots") - 1),
                  F.col("rest") - F.col("_i") * block + F.when(F.col("short_at") < F.col("_i"), F.col("short")).otherwise(0)
                  ).otherwise(F.lit(block))
    slots = slots.withColumns({"words": F.least(full, left), "cut": left < full})
    return slots.select(F.floor(F.col("_place") / shard_slots).alias("shard"),
                        (F.col("_place") % shard_slots).alias("slot"), "source", "pass", "block", "words", "cut")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block that a document with words reaches into."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    return placed.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))


def mix_counts(docs: DataFrame, block: int = BLOCK, seed: int = 1, weights=WEIGHTS,
               max_repeat: int = MAX_REPEAT) -> DataFrame:
    """id, size, source_size, target, taken: how many words of each document the mix takes.

    ``docs`` has id, source and size (words; null counts as 0). Every row gives one row, also
    repeated ones, empty ones (taken 0) and those without an id or source; null is a source of
    its own. No document is taken more than ``max_repeat`` times its size. An empty table
    gives an empty table.
    """
    docs = docs.select("id", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    placed, sizes = layout(docs)
    placed, quota = materialized(placed), materialized(quotas(sizes, block, seed, weights, max_repeat))
    drawn = draw(quota, block, seed).groupBy("source", "block").agg(
        F.count_if(~F.col("cut")).alias("_full"), F.max(F.when(F.col("cut"), F.col("words"))).alias("_cut"))
    drawn = drawn.withColumnsRenamed({"source": "_s", "block": "_b"})
    low, high = F.greatest("start", F.col("block") * block), F.col("start") + F.col("size")
    # The slots come from a row per source, so Spark takes them for a small table; they are not.
    drawn = drawn.hint("merge")
    whole = F.least(high, (F.col("block") + 1) * block) - low
    part = F.greatest(F.lit(0), F.least(high, F.col("block") * block + F.coalesce("_cut", F.lit(0))) - low)
    taken = (pieces(placed, block)
             .join(drawn, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
             # A document with words is known by its place.
             .groupBy("source", "start").agg(
                 F.any_value("id").alias("id"), F.any_value("size").alias("size"),
                 F.sum(F.coalesce("_full", F.lit(0)) * whole + part).alias("taken")))
    out = taken.select("id", "source", "size", "taken").unionByName(
        placed.filter("size = 0").select("id", "source", "size", F.lit(0).cast("bigint").alias("taken")))
    q = quota.select(F.col("source").alias("_s"), "source_size", "target")
    return (out.join(q, F.col("source").eqNullSafe(F.col("_s")))
            .select("id", "source", "size", "source_size", "target", "taken"))


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = 1, weights=WEIGHTS,
                  max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix as documents (doc_id, text, source and further columns as in ``docs``).

    A document comes back once for each whole pass over its source, unchanged, and once with
    the words that the partial pass drew from it, joined by one space; if these are all its
    words, unchanged. Documents without a drawn word are not in the mix. ``n_chars``, if
    there, follows the text. Rows that repeat doc_id, text and source are drawn together.
    """
    text = text_or_empty()
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h")).alias("id"),
                        F.col("source"), n_words(text).alias("size")).distinct()
    placed, sizes = layout(keyed)
    placed, quota = materialized(placed), materialized(quotas(sizes, block, seed, weights, max_repeat))
    of_source = quota.select(F.col("source").alias("_q"), "passes", "rest_slots")
    drawn = draw(quota, block, seed)
    drawn = drawn.join(of_source, F.col("source").eqNullSafe(F.col("_q")))
    last = drawn.filter(F.col("pass") == F.col("passes")).select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), "words").hint("merge")
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.coalesce("words", F.lit(0)))
    ranges = (pieces(placed, block)
              .join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
              .withColumns({"_from": low - F.col("start"), "_n": F.greatest(F.lit(0), high - low)})
              .groupBy("source", "start").agg(
                  F.any_value("id").alias("id"), F.any_value("size").alias("size"), F.sum("_n").alias("_drawn"),
                  F.sort_array(F.collect_list(F.when(F.col("_n") > 0, F.struct("_from", "_n")))).alias("_ranges")))
    plan = ranges.join(of_source, F.col("source").eqNullSafe(F.col("_q"))).filter("passes > 0 OR _drawn > 0").select(
        F.col("source").alias("_source"), F.col("id.id").alias("_id"), F.col("id.h").alias("_h"), "passes", "_drawn", "_ranges",
        (F.col("_drawn") == F.col("size")).alias("_all")).hint("merge")
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(text).alias("_text_hash"))
    joined = rows.join(plan, (F.col("_text_hash") == F.col("_h")) & F.col("_row.doc_id").eqNullSafe(F.col("_id"))
                       & F.col("_row.source").eqNullSafe(F.col("_source")))
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0))
    drawn_text = F.when(F.col("_all"), F.col("_row.text")).when(F.col("_drawn") > 0, F.array_join(F.flatten(F.transform(
        "_ranges", lambda r: F.slice(words, (r["_from"] + 1).cast("int"), r["_n"].cast("int")))), " "))
    texts = F.concat(F.array_repeat(F.col("_row.text"), F.col("passes").cast("int")), F.array(drawn_text))
    out = joined.select("_row", F.explode(texts).alias("_out")).filter(F.col("_out").isNotNull())
    changed = {"text": F.col("_out"), "n_chars": F.char_length("_out").cast("bigint")}
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
