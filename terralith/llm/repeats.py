"""Removal of byte strings that occur more than once, by sampled positions and the positions before them.

Every string of LENGTH bytes is assigned to one sampled position: the rightmost least hash of the 8-byte grams
that start in its first WINDOW bytes. As that depends on the string alone, equal strings are assigned to
positions at equal offsets, as a difference cover would give, with one position in about 80 instead of one in
eight. Sampled positions are named by the KEY bytes that all their strings share, and by all the bytes of their
strings (the context). Then

- contexts that occur twice make all their strings repeated,
- keys that occur once make none of their strings repeated,
- for the rest, the strings of one key are compared offset by offset.

Names are aggregated before they are dealt out. Only names cross the network for most positions; context bytes
go only for one position of each context of a key that has several.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import utf8, written

#: Bytes of a string that counts as repeated, gram starts it is sampled from, and what all strings of a position share.
LENGTH, WINDOW = 200, 160
KEY = LENGTH - WINDOW + 1
#: Bits of a Bloom filter for each entry, and at most in all: beyond that more positions pass it, none is lost.
BLOOM_BITS, BLOOM_MOST = 12, 1 << 28
#: Contexts of one key that a task compares; keys with more are compared by a shuffle of their strings.
CONTEXTS_AT_ONCE = 4096

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_BASES = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def sampled(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first string, last string) for each sampled position of a text: the starts of its strings."""
    n = len(text) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    grams = np.ndarray(n + WINDOW - 1, "<u8", text, strides=(1,)).copy()
    grams = _mixed(grams) & ~_LOW | (_LOW - np.arange(len(grams), dtype=np.uint64))
    size = 1
    while 2 * size <= WINDOW:
        grams = np.minimum(grams[:-size], grams[size:])
        size *= 2
    if size < WINDOW:
        grams = np.minimum(grams[: size - WINDOW], grams[WINDOW - size :])
    at = (_LOW - (grams & _LOW)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return at[first], first, np.append(first[1:] - 1, n - 1)


def names(text: bytes, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the keys and of the contexts of sampled positions."""
    h = xxhash.xxh3_64_intdigest
    keys = np.fromiter((h(text[a : a + KEY]) for a in at.tolist()), np.uint64, len(at))
    contexts = np.fromiter((h(text[s : e + LENGTH], a - s) for a, s, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(at))
    return keys, contexts


def string_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all strings of LENGTH bytes of each text, one after another, and how many each text has."""
    data = np.frombuffer(b"".join(texts), "u1").astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(sizes - LENGTH + 1, 0)
    begins = np.cumsum(sizes) - sizes
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    out = np.zeros(len(starts), np.uint64)
    for base in _BASES:
        # sums of x[j] / base^j modulo 2^64, so that a difference times base^p is the hash of the string at p
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), base, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), pow(base, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(data * down[:-1])])
        out = _mixed(out + (sums[starts + LENGTH] - sums[starts]) * up[starts])
    return out, counts


class Bloom:
    """Bits for a set of hashes, in slices that separate tasks fill."""

    SLICES, PROBES = 64, 4

    def __init__(self, slice_bits: int, slices: dict[int, bytes]) -> None:
        self.bits, self.slices = slice_bits, np.stack([np.frombuffer(slices.get(i, bytes(slice_bits // 8)), "u1") for i in range(self.SLICES)])

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        probes = [_mixed(hashes + np.uint64(k * int(_MIX) & (1 << 64) - 1)) % np.uint64(bits) for k in range(1, Bloom.PROBES + 1)]
        return (hashes % np.uint64(Bloom.SLICES)).astype(np.int64), np.stack(probes).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        part, probes = self.places(hashes, self.bits)
        return np.logical_and.reduce([self.slices[part, p >> 3] >> (p & 7).astype("u1") & 1 for p in probes]).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame, n: int) -> Bloom:
        """hashes: one column h of n longs. The result's size is bounded by BLOOM_MOST bits."""
        bits = max(64, min(BLOOM_MOST, n * BLOOM_BITS) // cls.SLICES // 64 * 64)

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slices: dict[int, np.ndarray] = {}
            for b in batches:
                part, probes = cls.places(b.column("h").to_numpy().view(np.uint64), bits)
                for i in np.unique(part).tolist():
                    own = slices.setdefault(i, np.zeros(bits, bool))
                    own[probes[:, part == i].ravel()] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in slices.values()], pa.binary())], ["slice", "bits"])

        # each slice is filled in one partition, so that the driver gets it once
        dealt = hashes.select("h", F.expr(f"cast(pmod(cast(h as decimal(20,0)) + if(h < 0, 18446744073709551616, 0), {cls.SLICES}) as int)").alias("slice"))
        rows = dealt.repartition(cls.SLICES, "slice").select("h").mapInArrow(filled, "slice int, bits binary").collect()
        return cls(bits, {r["slice"]: bytes(r["bits"]) for r in rows})


def _joint(keys: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return _mixed(keys + _mixed(contexts))


def _instance(joint: np.ndarray, doc: int, tag: int, first: np.ndarray) -> np.ndarray:
    row = (doc * int(_MIX) + tag) & (1 << 64) - 1
    return _mixed(joint ^ _mixed(first.astype(np.uint64) + np.uint64(row)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc, named (whether that is the row's doc_id, or a hash of its text), tag, text as bytes.

    tag is another hash of the text: rows of one doc are told apart by 64 bits, rows without a doc_id by 128.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce("doc_id", F.xxhash64(text, F.lit(1))).alias("doc"), F.col("doc_id").isNotNull().alias("named"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))


def _named(rows: DataFrame) -> DataFrame:
    """key, context, n, rep (doc, tag, first): sampled positions, summed over each batch of documents."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, int], list] = {}
            for doc, tag, text in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), utf8(b.column("text")), strict=True):
                at, first, last = sampled(text)
                keys, contexts = names(text, at, first, last)
                for name, s in zip(zip(keys.view(np.int64).tolist(), contexts.view(np.int64).tolist(), strict=True), first.tolist(), strict=True):
                    if (own := seen.get(name)) is None:
                        seen[name] = [1, doc, tag, s]
                    else:
                        own[0] += 1
                        if (doc, tag, s) < (own[1], own[2], own[3]):
                            own[1:] = doc, tag, s
            key, context = (np.fromiter((k[i] for k in seen), np.int64, len(seen)) for i in (0, 1))
            columns = [np.fromiter((v[i] for v in seen.values()), t, len(seen)) for i, t in enumerate((np.int64, np.int64, np.int64, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, context, *columns)], ["key", "context", "n", "doc", "tag", "first"])

    return rows.mapInArrow(positions, "key bigint, context bigint, n bigint, doc bigint, tag bigint, first int")


FOUND = "key bigint, context bigint, doc bigint, tag bigint, at int, first int, last int, bytes binary"


def _asked(rows: DataFrame, twice: Bloom, asked: Bloom) -> DataFrame:
    """Positions whose context may occur twice, and with their bytes those that may be asked for."""
    shared = rows.sparkSession.sparkContext.broadcast((twice, asked))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, asked = shared.value
        for b in batches:
            parts: list[list] = [[] for _ in range(8)]
            for doc, tag, text in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), utf8(b.column("text")), strict=True):
                at, first, last = sampled(text)
                if not len(at):
                    continue
                keys, contexts = names(text, at, first, last)
                joint = _joint(keys, contexts)
                sent = asked.contains(_instance(joint, doc, tag, first))
                some = np.flatnonzero(sent | twice.contains(joint))
                if len(some):
                    for part, x in zip(parts, (keys[some].view(np.int64), contexts[some].view(np.int64), np.full(len(some), doc, np.int64), np.full(len(some), tag, np.int64), at[some], first[some], last[some]), strict=False):
                        part.append(x)
                    parts[7] += [text[first[i] : last[i] + LENGTH] if sent[i] else None for i in some.tolist()]
            types = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
            arrays = [pa.array(np.concatenate([np.zeros(0, t), *part]).astype(t)) for part, t in zip(parts, types, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(parts[7], pa.binary())], ["key", "context", "doc", "tag", "at", "first", "last", "bytes"])

    return rows.mapInArrow(found, FOUND)


def _strings(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of the rows: its row, its start, and its hash with its key and its offset to the position."""
    first, at = (b.column(c).to_numpy().astype(np.int64) for c in ("first", "at"))
    hashes, counts = string_hashes(b.column("bytes").to_pylist())
    row = np.repeat(np.arange(len(counts)), counts)
    start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = b.column("key").to_numpy().view(np.uint64)
    return row, start, _mixed(hashes + _mixed(keys[row] + (at[row] - start).astype(np.uint64) * _MIX))


def _runs(b: pa.RecordBatch, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """doc, tag, first, last of the runs of starts that follow each other in a row."""
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(start) != 1)) + 1
    begin, end = np.concatenate([[0], cut])[: len(row)], np.append(cut, len(row))[: len(cut) + (len(row) > 0)] - 1
    own = row[begin].astype(np.int64)
    return pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(own)), b.column("tag").take(pa.array(own)), pa.array(start[begin].astype(np.int32)), pa.array(start[end].astype(np.int32))], ["doc", "tag", "first", "last"])


SPAN = "doc bigint, tag bigint, first int, last int"


def _compared(contexts: DataFrame, known: DataFrame) -> DataFrame:
    """Spans of strings that occur in another row of their key. contexts: rows of FOUND, one for each context."""
    # keys of so many contexts that no task holds them: one for CONTEXTS_AT_ONCE contexts at most
    large = written(known.where(F.col("contexts") > CONTEXTS_AT_ONCE).select("key").distinct(), "large-keys")
    few = contexts.join(large, "key", "left_anti")

    def locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def done(b: pa.RecordBatch) -> pa.RecordBatch:
            row, start, h = _strings(b)
            _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            some = counts[inverse] > 1
            return _runs(b, row[some], start[some])

        for batch in batches:
            for i in range(0, len(batch), CONTEXTS_AT_ONCE):
                part = batch.slice(i, CONTEXTS_AT_ONCE)
                held = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                # the last key may go on
                keys = held.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield done(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and len(held):
            yield done(held)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                b = batch.slice(i, 256)
                row, start, h = _strings(b)
                own = pa.array(row.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("doc").take(own), b.column("tag").take(own), pa.array(start.astype(np.int32))], ["h", "doc", "tag", "first"])

    near = few.repartition("key").sortWithinPartitions("key").mapInArrow(locally, SPAN)
    each = contexts.join(large, "key", "left_semi").select(*contexts.columns).mapInArrow(strings, "h bigint, doc bigint, tag bigint, first int")
    again = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return near.unionByName(each.join(again, "h").select("doc", "tag", "first", F.col("first").alias("last")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, tag, spans (array of first and last start of repeated strings) of the rows that have any."""
    rows = _rows(docs)
    summed = _named(rows).repartition("key").groupBy("key", "context").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "tag", "first")).alias("rep"))
    whole = Window.partitionBy("key")
    known = written(summed.withColumns({"all": F.sum("n").over(whole), "contexts": F.count(F.lit(1)).over(whole)}).where("all > 1").drop("all"), "repeated-names")
    twice, several = known.where("n > 1"), known.where("contexts > 1")

    def bloom(df: DataFrame, instance: bool) -> Bloom:
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = _joint(*(b.column(c).to_numpy().view(np.uint64) for c in ("key", "context")))
                if instance:
                    doc, tag, first = (b.column(c).to_numpy() for c in ("doc", "tag", "first"))
                    h = _mixed(h ^ _mixed(first.astype(np.uint64) + doc.view(np.uint64) * _MIX + tag.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

        return Bloom.of(df.select("key", "context", "rep.doc", "rep.tag", "rep.first").mapInArrow(hashed, "h bigint"), df.count())

    found = written(_asked(rows, bloom(twice, False), bloom(several, True)), "repeated-positions")
    full = found.join(twice.select("key", "context"), ["key", "context"]).select("doc", "tag", "first", "last")
    # a context found twice here, as a filter lets it pass or its row repeats, is a repeated one
    return full.unionByName(_compared(found.where("bytes is not null"), known)).groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def repeat_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes for every row of docs (doc_id, text).

    Removes each byte that is covered by a string of LENGTH bytes which also starts anywhere else in the table's
    texts. Null counts as empty; texts of fewer bytes stay whole. Rows that repeat are copies of each other, and
    lose all their strings. What is kept may break a character in two, so it is given as bytes. Other columns
    are not read.
    """
    spans = repeated_spans(docs)
    rows = _rows(docs).join(spans, ["doc", "tag"], "left")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(utf8(b.column("text")), b.column("spans"), strict=True):
                left, removed, runs = text, 0, 0
                if spans.is_valid:
                    first, last = (np.sort(spans.values.field(k).to_numpy()) for k in ("first", "last"))
                    # runs of bytes: a string that starts right after the last covered byte goes on with the run
                    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1] + LENGTH]))
                    begin, end = first[new], last[np.append(new[1:] - 1, len(last) - 1)] + LENGTH
                    removed, runs = int((end - begin).sum()), len(new)
                    pieces, at = [], 0
                    for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                        pieces.append(text[at:s])
                        at = e
                    left = b"".join([*pieces, text[at:]])
                for x, v in zip(out, (len(text), removed, runs, hashlib.sha256(left).hexdigest(), left), strict=True):
                    x.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("named"), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["doc", "named", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    out = rows.select("doc", "named", "text", "spans").mapInArrow(kept, "doc bigint, named boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary")
    return out.withColumn("doc_id", F.when(F.col("named"), F.col("doc"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
