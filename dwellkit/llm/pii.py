"""Personal data: patterns, and terms that reveal a protected entity.

Information-theoretic sanitisation: an entity (an address, number or card found by pattern) is
protected. A term in the same text reveals it as far as the corpus says so: with n(t)
different texts that hold the term and n(t, e) that hold both, of N, the term discloses
log n(t, e) / n(t) + log N / n(e) of the entity's information log N / n(e). Terms that disclose at least
``threshold`` of it are generalised or removed wherever they stand in a text with the entity.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.common import text_or_empty
from dwellkit.session import materialized

#: Kinds in the order of the report; ``term`` is added by the method.
KINDS = ("email", "ip", "card", "phone", "term")
THRESHOLD = 0.9
#: Different texts that must hold a pair. All copies of a text are one text, and one text counts.
MIN_TEXTS = 1
#: Bits of the map of hashes with copies: one MB.
COPY_BITS = 1 << 23
#: Different terms that a task holds before it hands their counts on.
FLUSH = 1 << 16

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A term: a run of letters of any script with their combining marks.
MARKS = re.escape("".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Mn", "Mc")))
TERM = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*")
ASCII_TERM = re.compile("[A-Za-z]+")
#: Scripts without spaces between words (Thai, Lao, Khmer, Burmese, kana, Han): there each substring of these lengths is a term too.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{2,}")
UNSPACED_LENGTHS = (2, 3, 4)
DIGITS = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, in linear time: each @ is extended to both sides."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(a, b, "email") for a, b in emails(text)]
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 8 <= len(DIGITS.sub("", m[0])) <= 15]
    return found


def entity(kind: str, value: str) -> str:
    """One name for all ways to write an entity."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else DIGITS.sub('', value)}"


def terms(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term in lower case) along the text, outside ``spans``."""
    covered, i = sorted((a, b) for a, b, _ in spans), 0
    for m in TERM.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        if i < len(covered) and covered[i][0] < m.end():
            continue
        yield m.start(), m.end(), m[0].lower()
        if m[0].isascii():
            continue
        for run in UNSPACED.finditer(m[0]):
            for n in UNSPACED_LENGTHS:
                for at in range(run.start(), run.end() - n + 1):
                    if n < len(m[0]):
                        yield m.start() + at, m.start() + at + n, m[0][at:at + n].lower()


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0], s[1])))


def different_terms(text: str, spans: list[tuple[int, int, str]]) -> list[str]:
    """All terms of the text once each, in order."""
    if spans or UNSPACED.search(text):
        return sorted({t for _, _, t in terms(text, spans)})
    return sorted({w.lower() for w in set((ASCII_TERM if text.isascii() else TERM).findall(text))})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text hash, base counts and spans; with an entity also the entities, terms and text."""
    schema = ("n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, "
              "entities array<string>, terms array<string>, held string")

    @F.pandas_udf(schema)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text) if text else []
            kinds = [k for _, _, k in base]
            line = listed(base)
            rows.append((*(kinds.count(k) for k in KINDS[:4]), line, hashlib.sha256(line.encode()).hexdigest(),
                         sorted({entity(k, text[a:b]) for a, b, k in base}),
                         different_terms(text, base) if base else [], text if base else None))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "entities", "terms", "held"])
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), of(text).alias("s")).select("id", "h", "s.*")


def once_each(docs: DataFrame, scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """(text): every text of ``docs`` once; only texts that may have copies are shuffled.

    Hashes with copies set a bit in a map of ``COPY_BITS`` bits, whatever their number. A row whose
    bit is not set has no copy; the others meet by hash.
    """
    bit = F.pmod(F.col("h"), F.lit(COPY_BITS))
    words = (scanned.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .groupBy(F.shiftright(bit, 5).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).collect())
    bits = np.zeros(COPY_BITS // 32, np.int64)
    for r in words:
        bits[r["word"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def copied(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy(np.int64) % COPY_BITS
        return pd.Series((shared.value[at >> 5] >> (at & 31)) & 1 == 1)
    text = text_or_empty(text_col)
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).withColumn("_copied", copied("h"))
    return rows.filter(~F.col("_copied")).select("text").unionByName(
        rows.filter("_copied").groupBy("h").agg(F.first("text").alias("text")).select("text"))


def disclosing(docs: DataFrame, scanned: DataFrame, threshold: float = THRESHOLD, min_texts: int = MIN_TEXTS,
               text_col: str = "text") -> DataFrame:
    """(h, term): the terms of each text, by its hash, that give away at least ``threshold`` of one of its entities.

    All counts are of different texts (by hash), so neither copies nor identifiers matter. A term reveals an
    entity only if n(t) <= n(t, e) (N / n(e)) ** (1 - threshold), and n(t, e) is n(e) at most: so terms that are
    frequent for the entities of their text fall before any pair is made. A term of one text alone reveals each
    entity of it that not every text holds, and needs no pair either.
    """
    texts = materialized(scanned.filter(F.size("entities") > 0).groupBy("h").agg(
        F.first("entities").alias("entities"), F.first("terms").alias("terms")))
    total = scanned.select(F.count_distinct("h")).first()[0]

    def most(ne: Column) -> Column:
        # A little more than the bound: the exact test follows.
        return ne * F.pow(F.lit(total) / ne, F.lit(1 - threshold)) * F.lit(1 + 1e-9)
    held = texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("ne"))
    owned = materialized(texts.select("h", F.explode("entities").alias("entity")).join(held, "entity").filter(F.col("ne") < total)
                         .groupBy("h").agg(F.collect_list(F.struct("entity", "ne")).alias("owns"), F.max(most(F.col("ne"))).alias("most")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                found.update(different_terms(t, base_spans(t)))
                if len(found) >= FLUSH:
                    yield pd.DataFrame(list(found.items()), columns=["_term", "n"])
                    found.clear()
        yield pd.DataFrame(list(found.items()), columns=["_term", "n"])
    counts = (once_each(docs, scanned, text_col).mapInPandas(count, "_term string, n long")
              .groupBy("_term").agg(F.sum("n").alias("nt")))
    rare = materialized(texts.join(owned, "h").select("h", "most", F.explode("terms").alias("term"))
                        .join(counts, F.col("term") == F.col("_term")).filter("nt <= most").select("h", "term", "nt"))
    alone = F.col("nt") == 1 if min_texts <= 1 else F.lit(False)
    possible = F.filter("owns", lambda o: F.col("nt") <= most(o["ne"]))
    pairs = materialized(rare.filter(~alone).join(owned, "h").select("h", "term", "nt", F.explode(possible).alias("_o"))
                         .select("h", "term", "nt", "_o.*"))
    info = F.log(F.lit(total) / F.col("ne"))
    told = (pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n"), F.first("nt").alias("nt"), F.first("ne").alias("ne"))
            .filter((F.col("n") >= min_texts) & (F.log(F.col("n") / F.col("nt")) + info >= F.lit(threshold) * info)))
    told = told.select("entity", "term")
    return rare.filter(alone).select("h", "term").unionByName(pairs.join(told, ["entity", "term"]).select("h", "term")).distinct()


def term_spans(text_col: str, told_col: str) -> Column:
    """term:start:end of every occurrence of the told terms outside the base spans; null where there is none."""
    @F.pandas_udf("string")
    def of(texts: pd.Series, told: pd.Series) -> pd.Series:
        out = []
        for text, names in zip(texts, told):
            names = set() if names is None or text is None else set(names)
            found = sorted({(a, b) for a, b, t in terms(text, base_spans(text)) if t in names}) if names else []
            out.append(",".join(f"term:{a}:{b}" for a, b in found) or None)
        return pd.Series(out, dtype=object)
    return of(F.col(text_col), F.col(told_col))


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, min_texts: int = MIN_TEXTS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``; h hashes the text.

    ``spans`` lists kind:start:end (code points, end exclusive): the base ones, then every
    occurrence of the terms that disclose an entity of the text. Null and empty texts have none.
    Repeated rows each give a row; all texts enter the counts, once each, and are read whole. Other columns
    are not read; an empty table gives an empty result.
    """
    scanned = materialized(scan(docs, id_col, text_col))
    # A list per text, of its own terms.
    told = disclosing(docs, scanned, threshold, min_texts, text_col).groupBy(F.col("h").alias("_h")).agg(F.collect_list("term").alias("_told"))
    out = scanned.drop("terms", "entities").join(told, F.col("h") == F.col("_h"), "left")
    return out.select("id", "h", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.concat_ws(
        ",", F.when(F.col("base") != "", F.col("base")), term_spans("held", "_told")).alias("spans"))


def sanitised(docs: DataFrame, found: DataFrame, general: dict[str, str] | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` (see ``find_pii``) generalised to its kind, or removed.

    ``general`` gives the replacement of each kind ("" removes); the default is the kind in brackets.
    """
    names = {k: f"[{k.upper()}]" for k in KINDS} | (general or {})

    @F.pandas_udf("string")
    def of(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, s, names) if t and s else t for t, s in zip(texts, spans)], dtype=object)
    said = found.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("spans").alias("_spans")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(text_or_empty(text_col)).alias("_text_hash"))
    rows = rows.join(said, (F.col("_text_hash") == F.col("_h")) & F.col(f"_row.{id_col}").eqNullSafe(F.col("_id")), "left")
    new = of(F.col(f"_row.{text_col}"), F.col("_spans"))
    return rows.select(*[new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def replaced(text: str, spans: str, names: dict[str, str]) -> str:
    """Spans from the left, each by its kind's name; one that overlaps an earlier one only lengthens it."""
    cuts = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for start, end, kind in cuts:
        if start >= at:
            out += [text[at:start], names[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])
