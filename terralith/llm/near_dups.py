"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

A document's set is its distinct shingles of words. Each register of its sketch keeps the least hash of the
set under one hash function as its count of leading zeros and MANTISSA bits after the leading one. Documents
whose registers agree throughout a band meet in a bucket. What a link needs is decided on the full sets.

Equal sets are one class and take part once, by their least doc_id. Within a bucket each class is first
compared to one hub only. Components of those links then leave only pairs of classes that no chain of links
joins yet: the classes outside the largest component that meets a hub are held against all that meet it, block
by block. The collision-corrected estimate comes first, on registers alone; only the texts of classes with a likely
partner in a block are sent, and the full sets decide. No pairs are emitted but links that join two components, and
no link between two components is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, remove, utf8, written
from .components import components

#: Registers in a band and bands: at a similarity of 0.8 no band agrees once in 300,000 pairs.
ROWS, BANDS = 5, 32
REGISTERS = ROWS * BANDS
#: Bits after the leading one; with 6 bits for the leading zeros a register has 16.
MANTISSA = 10
#: Estimates lie below the similarity by this much in fewer than one of 10^9 pairs near the threshold.
ESTIMATE_SLACK = 0.2
#: Members compared to one copy of their hub, so that a hub of very many members is spread.
MEMBERS_AT_ONCE = 500
#: Classes outside the largest component of a cluster that a task holds, and members that it reads.
OUTSIDE_AT_ONCE, MEMBERS_OF_TASK = 2048, 4096
#: Of the classes held, those that meet members at a time, and the elements of their sets.
ROWS_AT_ONCE, ELEMENTS_AT_ONCE = 128, 1 << 18
#: Distinct words whose hashes a task keeps.
MEMO = 1 << 20

_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, REGISTERS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, size: int, memo: dict) -> np.ndarray:
    """The sorted hashes of the distinct shingles; fewer words than size are one shingle, none no set."""
    words = text.lower().split()
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(hashes) < size:
        hashes = np.concatenate([np.zeros(size - len(hashes), np.uint64), hashes]) if len(hashes) else hashes
    if not len(hashes):
        return hashes
    out = _mixed(hashes[: len(hashes) - size + 1])
    for k in range(1, size):
        out = _mixed(out * _SECOND + hashes[k : len(hashes) - size + 1 + k])
    return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[None, i : i + 2048] * _ODD[:, None]
        part += _ADD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    significand, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    bits = np.minimum((significand - 0.5) * (2 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | bits


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A hash for each band of each sketch (rows) that holds the band's number."""
    parts = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _SECOND, parts.shape[:2])
    for k in range(ROWS):
        out = _mixed(out * _SECOND + parts[:, :, k] + np.uint64(1))
    return out


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of sets of sizes n and m are equal where the hashes aren't: they meet in a cell of
    2^-MANTISSA of its octave, n m / (n + m)^2 times the mean width of a cell, 1 / (2 ln 2) of its place."""
    return n * m / (n + m) ** 2 / (2 * np.log(2)) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets of sizes n and m from their registers (rows), corrected for collisions."""
    chance = collision(n, m)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


SKETCHED = "doc_id bigint, n_shingles bigint, hi bigint, lo bigint, registers binary"


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, hi and lo (digest of the set), registers (empty for empty sets) for every row of docs."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for b in batches:
            n, digests, registers = [], [], []
            for text in utf8(b.column("text")):
                shingles = shingle_set(text, size, memo)
                n.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                registers.append(sketch(shingles).tobytes() if len(shingles) else b"")
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "hi", "lo", "registers"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(sketched, SKETCHED)


def _banded(classes: DataFrame) -> DataFrame:
    """id, bucket: a row for each band."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            registers = np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            ids = np.repeat(b.column("id").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(band_keys(registers).ravel().view(np.int64))], ["id", "bucket"])

    return classes.select("id", "registers").mapInArrow(banded, "id bigint, bucket bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union. texts: id, text (binary).

    Each pair takes b's text to a copy of a's; a copy serves at most about MEMBERS_AT_ONCE pairs.
    """
    pairs = written(pairs, "pairs")
    shares = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.count(F.lit(1)) / MEMBERS_AT_ONCE) + 1).alias("shares"))
    dealt = join_spread(pairs, shares, ["a"], ["b"]).select("a", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"), "b")
    hubs = shares.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), F.col("a").alias("b"))
    asked = dealt.withColumn("member", F.lit(1)).unionByName(hubs.withColumn("member", F.lit(0)))
    told = texts.select(F.col("id").alias("b"), "text").join(asked, "b").repartition("a", "share").sortWithinPartitions("a", "share", "member")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, at, hub = _WordHashes(), None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, b, member, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("member").to_pylist(), utf8(batch.column("text")), strict=True):
                own = shingle_set(text, size, memo)
                if not member:
                    at, hub = a, own
                    continue
                assert at == a
                common = len(np.intersect1d(hub, own, assume_unique=True))
                if 100 * common >= percent * (len(hub) + len(own) - common):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return told.select("a", "b", "member", "text").mapInArrow(compared, "a bigint, b bigint")


def _close_sizes(n: Column, m: Column, percent: int) -> Column:
    """Sets can only be linked if the smaller one is large enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose estimate isn't far below the threshold."""
    own = classes.select("id", "n_shingles", "registers")
    hubs = own.toDF("a", "n", "ra").join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("times")), "a")
    rows = join_spread(pairs, hubs, ["a"], ["b"], "times", total=pairs.count()).join(own.toDF("b", "m", "rb"), "b").where(_close_sizes(F.col("n"), F.col("m"), percent))
    least = percent / 100 - ESTIMATE_SLACK

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("n", "m"))
            yield batch.filter(pa.array(estimate(ra, rb, n, m) >= least)).select(["a", "b"])

    return rows.mapInArrow(likely, "a bigint, b bigint")


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one, by the places of the left sets' elements.

    One right set at a time: it meets each of these places once at most, so that sets with very many common elements
    take no more memory than the left ones."""
    owner = np.repeat(np.arange(len(left)), [len(x) for x in left])
    elements = np.concatenate(left)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    out = np.zeros((len(right), len(left)), np.int64)
    for row, x in zip(out, right, strict=True):
        begin, end = np.searchsorted(elements, x, "left"), np.searchsorted(elements, x, "right")
        size = end - begin
        where = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row[:] = np.bincount(owner[where], minlength=len(left))
    return out.T


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Slices of at most ROWS_AT_ONCE sets of these sizes, with at most ELEMENTS_AT_ONCE elements or of one set."""
    at = n = 0
    for k, size in enumerate(sizes):
        if k > at and (k - at >= ROWS_AT_ONCE or n + size > ELEMENTS_AT_ONCE):
            yield slice(at, k)
            at, n = k, 0
        n += size
    if len(sizes):
        yield slice(at, len(sizes))


class _Apart:
    """Classes of one cluster in different components: those outside the largest against a part of all of them."""

    def __init__(self, size: int, percent: int) -> None:
        self.size, self.percent, self.memo = size, percent, _WordHashes()
        self.rows: list[tuple] = []
        self.registers = np.zeros((0, REGISTERS), np.uint16)
        self.joined: dict[int, int] = {}

    def root(self, c: int) -> int:
        while (p := self.joined.get(c, c)) != c:
            c = p
        return c

    def likely(self, others: list[tuple]) -> np.ndarray:
        """Which of the rows and others, in different components, may be linked. Rows: id, component, n, registers."""
        if len(self.registers) != len(self.rows):
            self.registers = np.stack([np.frombuffer(r[3], np.uint16) for r in self.rows])
        theirs = np.stack([np.frombuffer(r[3], np.uint16) for r in others])
        n, m = np.array([r[2] for r in self.rows], float)[:, None], np.array([r[2] for r in others], float)[None]
        own, other = (np.array([self.root(r[1]) for r in rows]) for rows in (self.rows, others))
        out = np.empty((len(self.rows), len(others)), bool)
        for at in range(0, len(self.rows), ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            equal = np.zeros(out[part].shape, np.int16)
            for k in range(REGISTERS):
                equal += self.registers[part, k, None] == theirs[None, :, k]
            chance = collision(n[part], m)
            out[part] = (equal / REGISTERS - chance) / (1 - chance) >= self.percent / 100 - ESTIMATE_SLACK
            out[part] &= 100 * np.minimum(n[part], m) >= self.percent * np.maximum(n[part], m)
            out[part] &= own[part, None] != other[None]
        return out

    def links(self, others: list[tuple]) -> list[tuple[int, int]]:
        """Links that join components, one for each two that they join. Rows end with their text."""
        likely = self.likely(others)
        a, b = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
        if not len(a):
            return []
        if not hasattr(self, "sets"):
            self.sets = [shingle_set(r[4], self.size, self.memo) for r in self.rows]
        sets = [shingle_set(others[j][4], self.size, self.memo) for j in b]
        m = np.array([len(x) for x in sets])[None]
        out = []
        for part in _slices([len(self.sets[i]) for i in a]):
            rows = a[part]
            n = np.array([len(self.sets[i]) for i in rows])[:, None]
            common = _counts([self.sets[i] for i in rows], sets)
            linked = likely[np.ix_(rows, b)] & (100 * common >= self.percent * (n + m - common))
            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = self.rows[rows[i]], others[b[j]]
                p, q = self.root(x[1]), self.root(y[1])
                if p != q:
                    self.joined[max(p, q)] = min(p, q)
                    out.append((x[0], y[0]))
        return out


def _by_block(batches: Iterator[pa.RecordBatch], names: list[str], apart, told) -> Iterator[list]:
    """What told(held, waiting) gives for each part of each (hub, block, share). Rows: place, member, then names."""
    at, held, waiting = None, apart(), []
    for batch in batches:
        out: list = []
        columns = (batch.column(c).to_pylist() for c in ("hub", "block", "share", "member", *names))
        for hub, block, share, member, *row in zip(*columns, strict=True):
            if at != (hub, block, share):
                out += told(held, waiting) if held.rows and waiting else []
                at, held, waiting = (hub, block, share), apart(), []
            (waiting if member else held.rows).append(tuple(row))
            if len(waiting) >= 512:
                out += told(held, waiting) if held.rows else []
                waiting = []
        yield out
    yield told(held, waiting) if held.rows and waiting else []


def _links_apart(clusters: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components within a cluster (hub, id, component): enough to join all that any link joins.

    The classes outside a cluster's largest component are held against all of the cluster, in parts: a task has at
    most about OUTSIDE_AT_ONCE of the former in memory, and reads about MEMBERS_OF_TASK of the latter. Registers go
    to all parts first; texts go only to parts in which their class has a likely partner.
    """
    sizes = clusters.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("hub").agg(F.max(F.struct("n", (-F.col("component")).alias("minus"))).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = F.floor((F.col("all") - F.col("main.n")) / OUTSIDE_AT_ONCE) + 1
    shares = F.floor(F.col("all") / MEMBERS_OF_TASK) + 1
    whole = written(whole.select("hub", (-F.col("main.minus")).alias("main"), blocks.alias("blocks"), shares.alias("shares"), "all"), "open-clusters")
    open_ = join_spread(clusters, whole, ["hub"], ["id"], "all")
    zero = F.lit(0).cast("bigint")
    place = ["hub", "block", "share", "member"]
    outside = open_.where("component <> main").select("hub", "id", "component", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.sequence(zero, F.col("shares") - 1)).alias("share"), F.lit(0).alias("member"))
    inside = open_.select("hub", "id", "component", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), "shares").alias("share"), F.lit(1).alias("member"))
    rows = outside.unionByName(inside).join(classes.select("id", F.col("n_shingles").alias("n"), "registers"), "id")
    dealt = lambda df: df.repartition("hub", "block", "share").sortWithinPartitions(*place)
    names = ["id", "component", "n", "registers"]
    apart = lambda: _Apart(size, percent)

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a likely partner in their part, once or more."""

        def told(held: _Apart, waiting: list[tuple]) -> list[tuple]:
            likely = held.likely(waiting)
            return [(*held.rows[i], 0) for i in np.flatnonzero(likely.any(axis=1))] + [(*waiting[j], 1) for j in np.flatnonzero(likely.any(axis=0))]

        for out in _by_block(batches, [*names, "hub", "block", "share"], apart, told):
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [*names, *place])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links in _by_block(batches, [*names, "text"], apart, lambda held, waiting: held.links(waiting)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    schema = "id bigint, component bigint, n bigint, registers binary, hub bigint, block bigint, share bigint, member int"
    likely = written(dealt(rows).select(*place, *names).mapInArrow(hopeful, schema).dropDuplicates([*place, "id"]), "likely-apart")
    return dealt(likely.join(texts, "id")).select(*place, *names, "text").mapInArrow(compared, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    size: words in a shingle. percent: links need a Jaccard similarity of at least percent / 100.
    component_id is the least doc_id reachable over links, kept whether it is the row's own. Null and empty
    texts, and those without words, have the empty set, which is linked with nothing. Rows without a doc_id are
    linked with nothing: their component_id is null and they are kept. Rows that repeat a doc_id are one document.
    Other columns are not read.
    """
    sketched = written(sketches(docs, size), "sketches")
    digest = ["hi", "lo", "n_shingles"]
    heads = sketched.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    some = join_spread(sketched.where("n_shingles > 0").select("doc_id", *digest), heads, digest, ["doc_id"], how="left").select("doc_id", *digest, "id")
    ids = written(some.unionByName(sketched.where("n_shingles = 0").select("doc_id", *digest, F.lit(None).cast("bigint").alias("id"))), "classes")
    classes = sketched.join(heads.select(*digest, F.col("id").alias("doc_id")), [*digest, "doc_id"]).dropDuplicates(["doc_id", *digest]).select(F.col("doc_id").alias("id"), "n_shingles", "registers")
    classes = written(classes, "class-sketches")
    banded = _banded(classes)
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(join_spread(banded, shared, ["bucket"], ["id"]), "buckets")

    # the class that meets most others stands for its bucket; each class is compared to the hub it meets most often
    central = members.groupBy("id").agg(F.sum("n").alias("weight"))
    weighed = members.join(central, "id")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("hub"), F.max("n").alias("n"))
    hubs = written(hubs.select("bucket", F.col("hub.weight").alias("w"), (-F.col("hub.minus")).alias("hub"), "n"), "hubs")
    met = join_spread(members.select("bucket", "id"), hubs, ["bucket"], ["id"])
    met = written(met.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("times"), F.first("w").alias("w")), "meetings")
    first = met.where("id <> hub").groupBy("id").agg(F.max(F.struct("times", "w", "hub"))["hub"].alias("a")).select("a", F.col("id").alias("b"))
    candidates = met.select("id").distinct()
    texts = written(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).join(candidates.hint("shuffle_hash"), "id"), "candidates")
    links = written(confirmed(_likely(written(first, "first-pairs"), classes, percent), texts, size, percent), "links-to-hubs")
    part = components(links)

    # what still stands apart among the classes that meet a hub
    clusters = met.select("hub", "id").join(part, "id", "left").select("hub", "id", F.coalesce("component", "id").alias("component"))
    more = written(_links_apart(written(clusters, "clusters"), classes, texts, size, percent), "links-apart")
    final = components(links.union(more))
    for done in (sketched, classes, members, met, texts):
        remove(docs.sparkSession, done)

    out = ids.join(final, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
