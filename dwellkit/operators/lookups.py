"""Dimension lookups: defaults, validity ranges, candidate lists, learned maps, names.

No side is forced to broadcast: Spark measures a side at run time and broadcasts it only
below ``spark.sql.autoBroadcastJoinThreshold``, with a shuffled join (and skew splitting)
beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the substrings that names are indexed by.
GRAM = 3


def lookup_default(df: DataFrame, dim: DataFrame, on: list[str], value: str, default) -> DataFrame:
    """Equality lookup with a default for missing keys."""
    return (df.join(dim.select(*on, F.col(value).alias("_v")), on, "left")
            .withColumn(value, F.coalesce("_v", F.lit(default))).drop("_v"))


def override_merge(base: DataFrame, verdicts: DataFrame, on: list[str], label: str,
                   needs_check: Column) -> DataFrame:
    """A verdict replaces the automatic label; provenance and open gaps are recorded."""
    v = verdicts.select(*on, F.col(label).alias("_verdict"))
    found = F.col("_verdict").isNotNull()
    return (base.join(v, on, "left")
            .withColumn("resolved_label", F.coalesce("_verdict", label))
            .withColumn("label_source", F.when(found, "research").otherwise("deterministic"))
            .withColumn("gap", needs_check & ~found)
            .drop("_verdict"))


def valid_lookup(df: DataFrame, ranges: DataFrame, flat: DataFrame, alias: str, at: str,
                 name: str = "key") -> DataFrame:
    """Alias by validity years, else the flat map, else the lower-cased alias.

    ``ranges`` has (alias, valid_from, valid_to, key), ``flat`` has (alias, key). The alias
    equality drives the join; the years only filter within it.
    """
    r = ranges.select(F.col("alias").alias("_a"), "valid_from", "valid_to", F.col("key").alias("_rk"))
    f = flat.select(F.col("alias").alias("_f"), F.col("key").alias("_fk"))
    hit = (F.col(alias) == F.col("_a")) & F.col(at).between(F.col("valid_from"), F.col("valid_to"))
    return (df.join(r, hit, "left").join(f, F.col(alias) == F.col("_f"), "left")
            .withColumn(name, F.coalesce("_rk", "_fk", F.lower(alias)))
            .drop("_a", "valid_from", "valid_to", "_rk", "_f", "_fk"))


def first_candidate(df: DataFrame, keys: list[str], candidates: str, existing: DataFrame,
                    at: str, candidate_key: str) -> DataFrame:
    """First entry of the ordered candidate array that exists in the season, else NULL."""
    each = df.select(*keys, at, F.posexplode(candidates).alias("_pos", candidate_key))
    found = (each.join(existing.select(candidate_key, at).distinct(), [candidate_key, at])
             .groupBy(*keys, at).agg(F.min_by(candidate_key, "_pos").alias("found_key"),
                                     F.min("_pos").alias("found_pos")))
    return df.drop(candidates).join(found, [*keys, at], "left")


def canonical_key(name: Column, mapped: Column, top_level: Column, renames: dict[str, str],
                  top_prefix: str = "top:", other_prefix: str = "oth:") -> Column:
    """Mapped key, else the (renamed) last name token, else the prefixed raw name."""
    clean = F.lower(F.trim(name))
    token = F.element_at(F.split(F.regexp_replace(clean, r"\.", ""), r"\s+"), -1)
    renamed = F.coalesce(*[F.when(token == old, F.lit(new)) for old, new in renames.items()], token)
    return (F.when(top_level, F.concat(F.lit(top_prefix), F.coalesce(mapped, renamed)))
            .otherwise(F.concat(F.lit(other_prefix), clean)))


def learned_mapping(pairs: DataFrame, name: str, code: str, n: str) -> DataFrame:
    """Modal code per name from counted pairs, the smallest code on ties."""
    counts = pairs.groupBy(name, code).agg(F.sum(n).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("m"), F.col(code).alias("c")))
    return (counts.groupBy(name).agg(best.alias("_b"))
            .select(name, F.col("_b.c").alias(code), (-F.col("_b.m")).alias("support")))


def _grams(text: str, lengths: Column) -> Column:
    """The different substrings of ``text`` of the given lengths (an array), each once."""
    def of(n):
        last = F.length(text) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(lengths, of)))


def containing(tokens: DataFrame, token: str, names: DataFrame, name: str) -> DataFrame:
    """(token, _found): the smallest name that contains each token, letter case aside.

    An index lists the names of every substring of up to ``GRAM`` characters, a few rows per character
    of a name whatever its length. A token asks for the rarest of its own and the names found
    there are compared in full; names travel by hash until then. Null and empty tokens find nothing.
    """
    asked = tokens.select(F.lower(token).alias("_token")).filter(F.length("_token") > 0).distinct()
    held = names.select(F.col(name).alias("_found"), F.lower(name).alias("_low")).filter(F.col("_low").isNotNull()).distinct()
    every = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    index = held.select(F.xxhash64("_found").alias("_h"), F.explode(_grams("_low", every)).alias("_gram"))
    sizes = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    longest = F.array(F.least(F.length("_token"), F.lit(GRAM)))
    rarest = (asked.select("_token", F.explode(_grams("_token", longest)).alias("_gram")).join(sizes, "_gram", "left")
              .groupBy("_token").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r"))
              .filter("_r.n > 0").select("_token", F.col("_r.gram").alias("_gram")))
    found = (rarest.join(index, "_gram").select("_token", "_h").join(held.withColumn("_h", F.xxhash64("_found")), "_h")
             .filter(F.col("_low").contains(F.col("_token"))))
    return found.groupBy("_token").agg(F.min("_found").alias("_found")).withColumnRenamed("_token", token)


def exact_then_substring(df: DataFrame, name: str, dim: DataFrame, dim_name: str,
                         values: dict[str, object]) -> DataFrame:
    """Exact name match, else the first dimension name that contains the last token, else defaults.

    Only names without an exact match take the second step (see ``containing``); the smallest name wins.
    """
    names = df.select(name).distinct()
    exact = names.join(dim.select(F.col(dim_name).alias(name)), name, "left_semi")
    rest = (names.join(exact, name, "left_anti")
            .withColumn("_last", F.lower(F.element_at(F.split(name, " "), -1))))
    near = rest.join(containing(rest, "_last", dim, dim_name), "_last").select(name, "_found")
    matched = (exact.withColumn("_found", F.col(name)).withColumn("match_kind", F.lit("exact"))
               .unionByName(near.withColumn("match_kind", F.lit("token"))))
    d = dim.select(F.col(dim_name).alias("_found"), *values)
    out = df.join(matched.join(d, "_found"), name, "left").drop("_found")
    out = out.withColumn("match_kind", F.coalesce("match_kind", F.lit("none")))
    for col, default in values.items():
        out = out.withColumn(col, F.coalesce(col, F.lit(default)))
    return out


def shared_members(df: DataFrame, names: str, primary: str, keep: list[str], member: str = "member") -> DataFrame:
    """"A/B" rows as one row per member with a primary flag."""
    each = F.explode(F.split(names, "/"))
    return (df.select(*keep, F.trim(primary).alias("_primary"), each.alias("_m"))
            .select(*keep, F.trim("_m").alias(member), (F.trim("_m") == F.col("_primary")).alias("is_primary"))
            .groupBy(*keep, member).agg(F.bool_or("is_primary").alias("is_primary")))


def with_schemes(df: DataFrame, schemes: dict[str, tuple[int, int]], duration: str) -> DataFrame:
    """Every row under every binning scheme; the schemes are a fixed list, not a table."""
    options = F.array(*[F.struct(F.lit(n).alias("scheme"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                        for n, (lo, hi) in schemes.items()])
    d = F.col(duration)
    return (df.withColumn("_s", F.explode(options)).select(*df.columns, "_s.*")
            .withColumn("scheme_class", F.when(d <= F.col("lo"), 0).when(d <= F.col("hi"), 1).otherwise(2))
            .drop("lo", "hi"))


def without(df: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(listed, on, "left_anti")
