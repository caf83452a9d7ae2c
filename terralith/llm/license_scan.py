"""License scan: exact set-similarity join of text blocks with license templates, DataFrame functions only.

A text holds a template of n words if n of its consecutive words (or all, if it has fewer) contain at least the
threshold's share of the template's distinct words, wherever they stand and however long the template is.

For the join, a text is cut into blocks: for templates of up to S words, S a power of two, a block has 2 S words and
the next one starts after S, so that all n consecutive words lie whole in one. Template words are ordered by how many
documents of the table contain them, rarest first. A template that needs k of its d distinct words can only be held by
a block with one of its first d - k + 1 words (prefix), with k words of the templates (length), and whose first common
word leaves enough words after it on both sides (position). What remains is counted in full, and then window by
window. Templates are tables that blocks are joined to; texts that repeat are joined once, by their digest.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, text_or_empty, written
from .license_texts import TEMPLATES

#: Between words, in the text with A-Z lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words from one block to the next, for the shortest templates.
SHORTEST = 16

#: The phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def span(words: int) -> int:
    """Words from one block to the next for a template of so many words: the least power of two that holds it."""
    return max(SHORTEST, 1 << (words - 1).bit_length())


def split_words(text: Column) -> Column:
    """The words of a text. Lower-casing other letters too changes no word's bounds, and none of them becomes a
    letter of the phrases; the first and last piece may be empty."""
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def word_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """All template words, those found in the fewest documents first; as many as the templates have, so of
    bounded size. Words found in none come first, ties in alphabetical order."""
    words = sorted({w for text in templates.values() for w in template_words(text)})
    if not words:
        return []
    held = F.array_intersect(F.array(*map(F.lit, words)), split_words(text_or_empty()))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = {r["word"]: r["n"] for r in counts.collect()}
    return sorted(words, key=lambda w: (n.get(w, 0), w))


def template_tables(spark: SparkSession, templates: dict[str, str], order: list[str], threshold: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Template words (span, word, rank), templates by their prefix words (span, rank, j, label, own, size, need), and
    the prefix words. own: the distinct words' ranks in order; j: the prefix word's place among them; size: words of
    the template, repeats included."""
    rank = {w: i for i, w in enumerate(order)}
    words, prefixes, first = set(), [], set()
    for label, text in sorted(templates.items()):
        all_words = template_words(text)
        own = sorted(rank[w] for w in set(all_words))
        need = math.ceil(threshold * len(own) - 1e-9)
        at = span(len(all_words))
        words |= {(at, order[r], r) for r in own}
        prefixes += [(at, r, j, label, own, len(all_words), need) for j, r in enumerate(own[: len(own) - need + 1])]
        first |= {order[r] for r in own[: len(own) - need + 1]}
    vocabulary = spark.createDataFrame(sorted(words), "span int, word string, rank int")
    return vocabulary, spark.createDataFrame(prefixes, "span int, rank int, j int, label string, own array<int>, size int, need int"), sorted(first)


def _most_in_a_window(places: Column, own: Column, size: Column) -> Column:
    """The most distinct ranks of own that lie in size consecutive places. places: array<struct<rank, at>>, sorted.

    A place is the first one of its rank in the windows that start after the place before it of that rank and after
    its own place less size, up to its own place: those starts are marked, and the marks summed up.
    """

    def marked(mine: Column) -> Column:
        def marks(x: Column, k: Column) -> Column:
            before = F.get(mine, k - 1)
            after = F.greatest(F.when(before["rank"] == x["rank"], before["at"]), x["at"] - size)
            return F.array(F.struct((after + 1).alias("p"), F.lit(1).alias("more")), F.struct((x["at"] + 1).alias("p"), F.lit(-1).alias("more")))

        def step(state: Column, x: Column) -> Column:
            now = state["now"] + x["more"]
            return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

        # marks that end come before those that begin
        events = F.array_sort(F.flatten(F.transform(mine, marks)))
        return F.aggregate(events, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda s: s["best"])

    return let(F.filter(places, lambda x: F.array_contains(own, x["rank"])), marked)


def template_matches(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """digest (of the text), labels, share (the largest one) of the texts that hold templates, a row for each text.

    A similarity join of blocks of words with templates, on prefix words.
    """
    spark = docs.sparkSession
    vocabulary, prefixes, first = template_tables(spark, templates, word_order(docs, templates), threshold)
    spans = sorted({span(len(template_words(t))) for t in templates.values()})
    words = split_words(text_or_empty())
    # texts without a prefix word hold no template
    some = docs.where(F.arrays_overlap(words, F.array(*map(F.lit, first)).cast("array<string>")))
    places = some.select(F.md5(text_or_empty().cast("binary")).alias("digest"), F.posexplode(words).alias("at", "word"))
    ranked = places.join(F.broadcast(vocabulary), "word")  # as many rows as the templates have words
    index = F.floor(F.col("at") / F.col("span")).cast("int")
    dealt = ranked.select("digest", "span", "rank", "at", F.explode(F.when(index > 0, F.array(index - 1, index)).otherwise(F.array(index))).alias("block"))
    blocks = dealt.groupBy("digest", "span", "block").agg(F.sort_array(F.collect_set("rank")).alias("held"), F.sort_array(F.collect_set(F.struct("rank", "at"))).alias("places"))
    tokens = blocks.select("*", F.posexplode("held").alias("i", "rank"))
    pairs = tokens.join(F.broadcast(prefixes), ["span", "rank"])  # as many rows as the templates have prefix words
    likely = (F.size("held") >= F.col("need")) & (F.least(F.size("held") - F.col("i"), F.size("own") - F.col("j")) >= F.col("need"))
    common = F.array_intersect("own", "held")
    # a pair is counted where it meets first
    full = pairs.where(likely).where((common[0] == F.col("rank")) & (F.size(common) >= F.col("need")))
    counted = full.select("digest", "label", "need", F.size("own").alias("words"), _most_in_a_window(F.col("places"), F.col("own"), F.col("size")).alias("most"))
    found = counted.where("most >= need").groupBy("digest").agg(F.sort_array(F.collect_set("label")).alias("held"), F.max(F.col("most") / F.col("words")).alias("share"))
    return written(found, "licenses")


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively, from 0."""
    parts = phrase.split()
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    rest = lambda i: [F.coalesce(F.get(words, i + k) == part, F.lit(False)) for k, part in enumerate(parts) if k]

    def follows(i: Column) -> Column:
        out = F.lit(True)
        for x in rest(i):
            out = out & x
        return out

    return F.filter(starts, follows)


def _base(words: Column) -> Column:
    """array<struct<label, at>> of every place of every phrase."""
    def marked(phrase: str, label: str) -> Column:
        return F.transform(_places(words, phrase), lambda i: F.struct(F.lit(label).alias("label"), i.cast("bigint").alias("at")))

    return F.concat(*[marked(p, label) for p, label in PHRASES.items()])


def license_scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text).

    labels: of the phrases and of the templates (TEMPLATES unless given, by label) that the text holds. score: the
    largest share of a template found, 1 where a phrase stands, else 0. Null and empty texts have no words and no
    labels. Repeated rows have a result each. Templates without words are found nowhere. Other columns are not read.
    """
    templates = {k: t for k, t in (TEMPLATES if templates is None else templates).items() if template_words(t)}
    none = F.array().cast("array<struct<label:string,at:bigint>>")

    def scanned(words: Column) -> Column:
        marks = F.array(*[F.lit(p.split()[0]) for p in PHRASES])
        return F.struct(F.size(words).cast("bigint").alias("n_words"), F.when(F.arrays_overlap(words, marks), _base(words)).otherwise(none).alias("base"))

    rows = docs.select("doc_id", F.md5(text_or_empty().cast("binary")).alias("digest"), let(split_words(text_or_empty()), scanned).alias("s"))
    rows = rows.join(template_matches(docs, templates, threshold), "digest", "left") if templates else rows.withColumns({"held": F.lit(None).cast("array<string>"), "share": F.lit(None).cast("double")})
    base, at = F.col("s.base"), F.transform("s.base", lambda x: x["at"])
    labels = F.sort_array(F.array_distinct(F.transform(base, lambda x: x["label"])))
    return rows.select(
        "doc_id",
        F.col("s.n_words").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.concat_ws(",", labels).alias("base_labels"),
        F.concat_ws(",", F.sort_array(F.array_union(labels, F.coalesce("held", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
