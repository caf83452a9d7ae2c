"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document. The ledger holds the measurements and one bit for each rule
that failed. Policies are versioned masks over those bits: applying another version, or asking what a rule
alone costs, reads the ledger and not the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, text_or_empty

#: Words lie between characters of this class.
BLANK = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Words in a window of the repetition measure.
WINDOW = 5

#: name: (bit, failure from the measurements). Ratios are kept in whole numbers. A bit is never given to another rule.
RULES: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "few_words": (0, lambda m: m["n_words"] < 10),
    "repeated_words": (1, lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    "symbols": (2, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    "repeated_lines": (3, lambda m: (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    "short_words": (4, lambda m: m["word_chars"] < 2 * m["n_words"]),
    "long_words": (5, lambda m: (m["word_chars"] > 12 * m["n_words"])),
}

#: Versions of what counts as a failure. A published version is never changed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "2": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "3": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}
CURRENT = "3"


def mask(version: str) -> int:
    return sum(1 << RULES[name][0] for name in POLICIES[version])


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows found twice or more, from the hashes of a text's words."""
    starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(0), F.size(hashes) - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))

    def covered(places: Column) -> Column:
        # each window covers its words up to the next repeated one
        gaps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        same = lambda s, k: F.coalesce(F.get(ordered, k)["h"] == s["h"], F.lit(False))
        twice = F.filter(ordered, lambda s, k: same(s, k - 1) | same(s, k + 1))
        return F.sort_array(F.transform(twice, lambda s: s["i"]))

    def counted(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(let(ordered, places), covered))

    return let(windows, counted)


def measurements(text: Column) -> Column:
    """Struct of a text's measurements; null counts as empty, and an empty text has 0 of everything."""

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), let(F.transform(words, lambda w: F.xxhash64(w)), _repeated).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    parts = F.struct(
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        (F.char_length(text) - F.regexp_count(text, F.lit(BLANK))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
    )
    flat = ("w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")

    def field(m: Column, path: str) -> Column:
        for name in path.split("."):
            m = m[name]
        return m

    return let(parts, lambda m: F.struct(*[field(m, p).alias(p.rpartition(".")[2]) for p in flat]))


def entry(text: Column) -> Column:
    """The measurements and fail_bits of a text, as one struct: evaluated once however it is used."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    def judged(m: Column) -> Column:
        bits = F.lit(0).cast("bigint")
        for bit, fails in RULES.values():
            bits = bits.bitwiseOR(F.when(fails(m), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
        return F.struct(*[m[n].alias(n) for n in names], bits.alias("fail_bits"))

    return let(measurements(text), judged)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits for every row of docs (doc_id, text).

    Null text counts as empty; it fails few_words. Repeated rows have an entry each. Other columns are not read.
    """
    return docs.select("doc_id", entry(text_or_empty()).alias("q")).select("doc_id", "q.*")


def passes(fail_bits: Column, version: str = CURRENT) -> Column:
    return fail_bits.bitwiseAND(F.lit(mask(version))) == 0


def verdicts(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a version of the policy."""
    return ledger(docs).withColumns({"base_failed": ~passes(F.col("fail_bits"), "base"), "kept": passes(F.col("fail_bits"), version)})


def kept_rows(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of docs that a version of the policy keeps, with their columns."""
    return docs.where(passes(entry(text_or_empty())["fail_bits"], version))


def ablation(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a version, from a ledger: rule, n_failed, n_only (documents that it alone rejects, which
    leaving it out would bring back) and n_kept_without. The ledger is first summed by its bits, of which there
    are no more patterns than the rules allow."""
    whole = mask(version)
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << RULES[name][0]).cast("bigint").alias("bit")) for name in POLICIES[version]]))
    rows = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0))).alias
    return rows.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(F.col("bits") == F.col("bit"))("n_only"),
        count(F.col("bits").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("bit"))) == 0)("n_kept_without"),
    )
