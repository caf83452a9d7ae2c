"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over the words of each text.

Words are what lies between separators in the text with A-Z lower-cased. Every n consecutive words of an item
are a window; an item of fewer words, but not none, is one window. A document's word is hit where it lies
inside an occurrence of a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import join_spread, utf8, written

#: Bytes 00-2F, 3A-60 and 7B-7F, once A-Z are lower-cased, separate words; the rest stay.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The windows of some items, by length, as word numbers. Items without an id hit, but are not named."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int) -> None:
        self.number: dict[bytes, int] = {}
        self.holders: dict[int, dict[bytes, set[str | None]]] = {}
        for item, text in items:
            words = words_of(text)
            ids = np.asarray([self.number.setdefault(w, len(self.number)) for w in words], "<i4")
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                self.holders.setdefault(size, {}).setdefault(ids[i : i + size].tobytes(), set()).add(item)

    def found(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.number.get, words, [-1] * len(words)), "<i4", len(words))
        known = ids >= 0
        if known.any():
            # how many words of the benchmark follow each other from here on
            stops = np.append(np.flatnonzero(~known), len(ids))
            run = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
            for size, windows in self.holders.items():
                for i in np.flatnonzero(run >= size).tolist():
                    if own := windows.get(ids[i : i + size].tobytes()):
                        hit[i : i + size] = True
                        items |= own
        return hit, items - {None}


def _runs(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view("i1"), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in edge.reshape(-1, 2)]


def _blocks(benchmark: DataFrame, most_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most most_words words, or of one longer item, read one after another."""
    block, n = [], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).distinct()
    for r in rows.toLocalIterator():
        text = bytes(r["text"])
        size = len(words_of(text))
        if block and n + size > most_words:
            yield block
            block, n = [], 0
        block.append((r["item"], text))
        n += size
    yield block


def _fresh(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as tell it from the columns of docs."""
    while name in docs.columns:
        name = f"_{name}"
    return name


SPANS, ITEMS = "array<struct<first:bigint,last:bigint>>", "array<string>"
RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _hits_of(block: list, docs: DataFrame, n: int) -> DataFrame:
    """digest (of a text), spans, items, n (rows) of the texts that a block of items hits, once for each text."""
    windows = docs.sparkSession.sparkContext.broadcast((block, n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Windows(*windows.value)
        for b in batches:
            which, spans, items = [], [], []
            for i, text in enumerate(utf8(b.column("text"))):
                hit, own = found.found(words_of(text))
                if hit.any():
                    which.append(i)
                    spans.append(_runs(hit))
                    items.append(sorted(own))
            yield pa.RecordBatch.from_arrays([b.column("digest").take(pa.array(which, pa.int64())), pa.array(spans, RUNS), pa.array(items, pa.list_(pa.string()))], ["digest", "spans", "items"])

    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("digest"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(scan, f"digest string, spans {SPANS}, items {ITEMS}").groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.count(F.lit(1)).alias("n"))


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, most_words: int, new: str, told: Callable) -> DataFrame:
    """The columns of docs and new ones, as told(batch, words, hits, items) gives batches of them: for each text how many
    words it has, which of them are hit, and the items that hit it.

    All blocks but the last leave what they hit, by the digest of the text; the scan for the last one adds it up. It is
    the only pass of the rows through Python, as each more takes a worker, and its memory, for each core.
    """
    count, spans_, items_, digest_ = (_fresh(docs, f"_{x}") for x in ("n", "spans", "items", "digest"))
    block, earlier = None, []
    for following in _blocks(benchmark, most_words):
        if block is not None:
            earlier.append(written(_hits_of(block, docs, n), "benchmark-hits"))
        block = following
    out = docs
    if earlier:
        both = reduce(DataFrame.unionByName, earlier).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias(spans_), F.flatten(F.collect_list("items")).alias(items_), F.max("n").alias(f"{count}_rows"))
        # texts without words need no partner, and are spread
        out = out.withColumn(digest_, F.when(F.length("text") > 0, F.md5(F.col("text").cast("binary"))))
        out = join_spread(out, written(both.withColumnRenamed("digest", digest_), "benchmark-hits"), [digest_], ["doc_id"], f"{count}_rows", how="left").drop(digest_, f"{count}_rows")
    else:
        out = out.withColumns({spans_: F.lit(None).cast(SPANS), items_: F.lit(None).cast(ITEMS)})
    windows = docs.sparkSession.sparkContext.broadcast((block, n))
    columns = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Windows(*windows.value)
        for b in batches:
            counts, hit, items = [], [], []
            for text, s, i in zip(utf8(b.column("text")), b.column(spans_).to_pylist(), b.column(items_).to_pylist(), strict=True):
                words = words_of(text)
                own, by = found.found(words)
                for x in s or ():
                    own[x["first"] : x["last"] + 1] = True
                counts.append(len(words))
                hit.append(own)
                items.append(sorted(by.union(i or ())))
            yield told(b.select(columns), counts, hit, items)

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(new).fields]) if new else docs.schema
    return out.select(*columns, spans_, items_).mapInArrow(scan, schema)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_words: int = 500_000) -> DataFrame:
    """docs with n_words, spans (maximal runs of hit words, from 0) and items (ids as strings, sorted), in place of
    columns of these names.

    The windows of a block of at most most_words benchmark words are broadcast; a larger benchmark is scanned
    for block after block, and each leaves the spans of the texts that it hits. Documents themselves are not written.
    Null has no words. Windows of items without an id hit too, but items lists ids only; repeated items count once.
    """
    docs = docs.drop("n_words", "spans", "items")

    def told(b: pa.RecordBatch, counts: list, hit: list, items: list) -> pa.RecordBatch:
        new = [pa.array(counts, pa.int64()), pa.array([_runs(x) for x in hit], RUNS), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "n_words", "spans", "items"])

    return _scanned(docs, benchmark, n, most_words, f"n_words bigint, spans {SPANS}, items {ITEMS}", told)


def _hit_words(spans: str):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"] + 1)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text)."""
    found = hits(docs.select("doc_id", "text"), benchmark, n)
    items = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", _hit_words("spans").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.2, most_words: int = 500_000) -> DataFrame:
    """docs without what the benchmark shares with them: a document goes if at least drop_share of its words
    are hit; else the hit words go, each span with what stands between its words. n_chars, where docs has it,
    follows a changed text. Documents without a hit stay as they are, null texts too."""

    def told(b: pa.RecordBatch, counts: list, hit: list, items: list) -> pa.RecordBatch:
        keep = [int(x.sum()) / max(k, 1) < drop_share for x, k in zip(hit, counts, strict=True)]
        b, hit = b.filter(pa.array(keep, pa.bool_())), [x for x, k in zip(hit, keep, strict=True) if k]
        which = [i for i, x in enumerate(hit) if x.any()]
        if not which:
            return b
        texts = b.column("text").to_pylist()
        lengths = b.column("n_chars").to_pylist() if "n_chars" in b.schema.names else None
        for i in which:
            texts[i] = without(texts[i], [(x["first"], x["last"]) for x in _runs(hit[i])])
            if lengths:
                lengths[i] = len(texts[i])
        new = {"text": pa.array(texts, b.column("text").type)}
        if lengths is not None:
            new["n_chars"] = pa.array(lengths, b.column("n_chars").type)
        return pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], b.schema.names)

    return _scanned(docs, benchmark, n, most_words, "", told)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words first to last of each span."""
    folded = np.frombuffer((data := text.encode()).translate(FOLD), "u1")
    inside = np.concatenate([[0], (folded != 0x20).view("i1"), [0]])
    edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    left, at = [], 0
    for first, last in spans:
        left.append(data[at : edges[first, 0]])
        at = edges[last, 1]
    return b"".join([*left, data[at:]]).decode()
