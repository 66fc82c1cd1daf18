"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Different labelled texts that the fit reads of each language, about; beyond it a hash-chosen share is read.
ROWS_PER_LANG = 4000
MAX_LANGS = 512
SMOOTHING = 0.5
SLICE = 1 << 19
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_slices(codes: np.ndarray, buckets: int, orders=ORDERS) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, a slice of it at a time.

    Code points that are no letter count as a space, runs of them as one, and a text begins
    and ends with one. A gram belongs to the slice that its first code point is in.
    """
    letter = _letters()[codes]
    plain = np.where(letter, codes, np.uint32(32))
    # A space stays right behind a letter only.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    plain = np.concatenate(([32], plain[keep], [32][:int(letter[-1:].all())])).astype(np.uint64)
    for at in range(0, len(plain), SLICE):
        part = plain[at:at + SLICE + max(orders) - 1]
        out = []
        for n in orders:
            m = min(SLICE, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for i in range(n):
                h = (h ^ part[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(20)) % np.uint64(buckets))
        if out:
            yield np.concatenate(out).astype(np.int64)


class Model:
    """Languages in order and the matrix of log probabilities, buckets by languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, rows: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.logp = np.log(smooth / smooth.sum(0)).astype(np.float32)
        self.prior = np.log(rows / rows.sum())

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, its posterior); (``und``, 0.0) for null and for a text without a letter."""
        codes = _codes(text) if text else np.empty(0, np.uint32)
        if not self.langs or not len(codes) or not _letters()[codes].any():
            return UNKNOWN, 0.0
        total = self.prior.copy()
        for grams in gram_slices(codes, len(self.logp)):
            # The text's sparse counts times the matrix.
            seen, n = np.unique(grams, return_counts=True)
            total += n @ self.logp[seen].astype(np.float64)
        best = int(total.argmax())
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, buckets: int = BUCKETS) -> Model:
    """Learn from the rows of ``docs`` (text, lang) whose lang is not null.

    Each different text counts once. About ``rows_per_lang`` texts of a language are read (all if there are fewer):
    those with the smallest hashes, so that copies neither fill the sample nor keep others out of it. The
    counts are buckets x languages numbers; more than
    ``MAX_LANGS`` languages are an error. Without labelled rows every prediction is ``und``.
    """
    known = docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang").filter(F.col("lang").isNotNull())
    sizes = (known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
             .orderBy("lang").limit(MAX_LANGS + 1).collect())
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(langs)}
    pick = F.lit(False)
    for r in sizes:
        mine = F.col("lang") == r["lang"]
        if r["texts"] > rows_per_lang:
            # A share of 63 bits, which no number of texts brings down to nothing.
            mine &= F.shiftrightunsigned(F.xxhash64("text"), 1) < (rows_per_lang << 63) // r["texts"]
        pick |= mine
    sample = known.filter(pick).dropDuplicates(["lang", "text"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                mine = found.setdefault(lang, np.zeros(buckets, np.int64))
                for grams in gram_slices(_codes(text), buckets):
                    mine += np.bincount(grams, minlength=buckets)
        for lang, mine in found.items():
            at = np.flatnonzero(mine)
            yield pd.DataFrame({"lang": number[lang], "bucket": at, "n": mine[at]})
    cells = (sample.mapInPandas(count, "lang int, bucket long, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((buckets, len(langs)))
    counts[cells["bucket"].to_numpy(np.int64), cells["lang"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    return Model(langs, counts, np.array([r["n"] for r in sizes], np.float64))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """struct<lang, score> of each text; the model (buckets x languages floats) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.score(t) for t in texts]
        return pd.DataFrame(found, columns=["lang", "score"])
    return of(F.col(text_col).cast("string"))


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, whose language can be told.

    Rejected are ``und`` (null, empty, no letter) and texts whose best language is less likely
    than ``min_score`` by the model.
    """
    said = predict(docs, model)
    rows = docs.select(F.struct("*").alias("_row"), said.alias("_said"))
    return (rows.filter((F.col("_said.lang") != UNKNOWN) & (F.col("_said.score") >= min_score))
            .select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
