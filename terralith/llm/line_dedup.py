"""Incremental line dedup: sharded cuckoo filters over exact, reversible reference counts.

The ledger keeps postings, one row (shard, key, doc_id, delta) for each document that gained (+1) or lost
(-1) a line key. Their sums are the exact reference counts, so that deleting documents undoes inserting
them. The keys whose count reaches the threshold stand in cuckoo filters, one for each shard. A probe asks
the filter of its shard first; only its hits, a few false ones among them, are counted exactly. Filters are read by
the tasks that probe them, a shard or a share of a shard in each, and never gathered in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, join_spread, shared_folder, utf8, written

STRIPPED = SPACE.encode()
POSTING = "shard int, hi bigint, lo bigint, doc_id bigint, delta int"
FILTER = "shard int, n_keys bigint, slots binary"
#: Postings that one group probes, about, at most, and a group's largest part of all shards' mean; a shard with more
#: is several groups, each with the filter.
POSTINGS_AT_ONCE, PART_OF_MEAN = 1 << 18, 2


class CuckooFilter:
    """Set of 64-bit hashes with 16-bit fingerprints in buckets of four; supports deletion.

    A fingerprint may stand in either of two buckets, the second one found from the first and the fingerprint
    alone. What finds no place after MAX_KICKS moves doubles the table.
    """

    SLOTS, MAX_KICKS, LOAD = 4, 500, 0.84

    def __init__(self, capacity: int = 0, slots: np.ndarray | None = None) -> None:
        if slots is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * self.LOAD)))))
            slots = np.zeros((buckets, self.SLOTS), np.uint16)
        self.slots = slots

    @staticmethod
    def _prints(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    def _places(self, hashes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        first = hashes & mask
        return first, self._other(first, prints)

    def _other(self, place, prints):
        mask = np.uint64(len(self.slots) - 1)
        return place ^ ((prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints = self._prints(hashes)
        first, second = self._places(hashes, prints)
        p = prints[:, None]
        return (self.slots[first] == p).any(axis=1) | (self.slots[second] == p).any(axis=1)

    def insert(self, hashes: Iterable[int]) -> bool:
        """False if the table is too full; a fingerprint is then without a place, and a larger table is due."""
        rng = 0x9E3779B9
        for h in np.asarray(list(hashes), np.uint64):
            fp = self._prints(h[None])[0]
            first, second = (int(x[0]) for x in self._places(h[None], fp[None]))
            for place in (first, second):
                free = np.flatnonzero(self.slots[place] == 0)
                if len(free):
                    self.slots[place, free[0]] = fp
                    break
            else:
                place = second
                for _ in range(self.MAX_KICKS):
                    rng = (rng * 1103515245 + 12345) & 0x7FFFFFFF
                    k = (rng >> 16) % self.SLOTS
                    fp, self.slots[place, k] = self.slots[place, k], fp
                    place = int(self._other(np.uint64(place), np.asarray(fp)))
                    free = np.flatnonzero(self.slots[place] == 0)
                    if len(free):
                        self.slots[place, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, hashes: Iterable[int]) -> None:
        """Removes one fingerprint for each hash; the hashes must have been inserted."""
        for h in np.asarray(list(hashes), np.uint64):
            fp = self._prints(h[None])[0]
            for place in (int(x[0]) for x in self._places(h[None], fp[None])):
                at = np.flatnonzero(self.slots[place] == fp)
                if len(at):
                    self.slots[place, at[0]] = 0
                    break

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        capacity = max(8, len(hashes))
        while not (made := cls(capacity)).insert(hashes):
            capacity *= 2
        return made

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(slots=np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(STRIPPED).lower()


def key_digest(key: bytes, min_chars: int) -> bytes | None:
    """16 bytes that stand for a key; None if it has fewer than min_chars code points."""
    if len(key) < min_chars or len(key) < 4 * min_chars and sum(1 for c in key if c & 0xC0 != 0x80) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class LineLedger:
    """Reference counts and filters in a folder that all executors share.

    root: the folder. min_chars, min_docs: keys of at least so many code points held by at least so many
    documents are duplicates. shards: of keys and filters; a task holds one shard's filter, 2.4 bytes for each key.
    """

    def __init__(self, spark: SparkSession, root: str, min_chars: int = 40, min_docs: int = 5, shards: int = 256) -> None:
        self.spark, self.root = spark, root
        self.min_chars, self.min_docs, self.shards = min_chars, min_docs, shards

    # what the folder holds
    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTING).option("basePath", f"{self.root}/postings").parquet(f"{self.root}/postings").select("shard", "hi", "lo", "doc_id", "delta")

    def refcounts(self) -> DataFrame:
        """shard, hi, lo, n_docs, last_doc of every key that a document still holds."""
        held = self.postings().groupBy("shard", "hi", "lo", "doc_id").agg(F.sum("delta").alias("n")).where("n > 0")
        return held.groupBy("shard", "hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def _post(self, docs: DataFrame, delta: int) -> DataFrame:
        min_chars, shards = self.min_chars, self.shards

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, digests = [], []
                for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                    own = {d for x in set(text.split(b"\n")) if (d := key_digest(line_key(x), min_chars))}
                    digests += own
                    ids += [doc] * len(own)
                hi, lo = _halves(digests)
                shard = (hi.view("<u8") % shards).astype("i4") if len(hi) else hi.astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(hi), pa.array(lo), pa.array(ids, pa.int64()), pa.array(np.full(len(hi), delta, "i4"))], ["shard", "hi", "lo", "doc_id", "delta"])

        out = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(keys, POSTING)
        return out.dropDuplicates(["shard", "hi", "lo", "doc_id"])

    def insert(self, docs: DataFrame) -> None:
        """Adds the line keys of docs (doc_id, text) and brings the filters up to date.

        Repeated rows of a doc_id are one document. Documents without a doc_id hold nothing. A document that
        changes is deleted with its old text and inserted with the new one.
        """
        self._change(self._post(docs, 1))

    def delete(self, docs: DataFrame) -> None:
        """Takes back what insert() of the same rows added."""
        self._change(self._post(docs, -1))

    def _change(self, postings: DataFrame) -> None:
        """Adds a batch of postings, and takes the keys that reach or lose the threshold by it into or out of their
        shards' filters. Each batch writes new filters beside the old ones, so that a batch that fails is repeated."""
        batch = self._batches()
        postings.write.mode("overwrite").parquet(f"{self.root}/postings/batch={batch}")
        held = self.spark.read.schema(f"{POSTING}, batch int").option("basePath", f"{self.root}/postings").parquet(f"{self.root}/postings")
        if batch:
            touched = held.where(F.col("batch") == batch).select("shard", "hi", "lo").distinct()
            held = held.join(touched, ["shard", "hi", "lo"], "left_semi")
        per_doc = held.groupBy("shard", "hi", "lo", "doc_id").agg(F.sum("delta").alias("now"), F.sum(F.when(F.col("batch") < batch, F.col("delta")).otherwise(0)).alias("then"))
        holders = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0)) >= self.min_docs
        due = per_doc.groupBy("shard", "hi", "lo").agg(holders("now").alias("now"), holders("then").alias("then")).where("now <> then")
        changes = due.select("shard", "lo", "now")

        def changed(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = int((old if len(old) else new)["shard"].iloc[0])
            keys, n = np.zeros(0, np.uint64), int(old["n_keys"].iloc[0]) if len(old) else 0
            gone = np.sort(new["lo"].to_numpy()[~new["now"].to_numpy(bool)].view("u8")) if len(new) else keys
            come = np.sort(new["lo"].to_numpy()[new["now"].to_numpy(bool)].view("u8")) if len(new) else keys
            if len(old) and old["slots"].iloc[0] is not None:
                held = CuckooFilter.from_bytes(old["slots"].iloc[0])
                held.delete(gone)
                if not held.insert(come):
                    held = None
            else:
                held = CuckooFilter.of(come)
            return pd.DataFrame({"shard": [shard], "n_keys": [n + len(come) - len(gone)], "slots": [held.to_bytes() if held else None]})

        before = self._filters(batch - 1) if batch else self.spark.createDataFrame([], FILTER)
        made = before.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(changed, FILTER)
        made.write.mode("overwrite").parquet(f"{self.root}/filters/{batch}")
        if self._filters(batch).where("slots is null").limit(1).count():
            self._grow(batch)

    def _grow(self, batch: int) -> None:
        """Builds the filters that have become too small anew, from the exact counts."""
        filters = self._filters(batch)
        small = filters.where("slots is null").select("shard")
        due = self.refcounts().where(F.col("n_docs") >= self.min_docs).join(F.broadcast(small), "shard")  # at most a row for each shard

        def built(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n_keys": [len(pdf)], "slots": [CuckooFilter.of(np.sort(pdf["lo"].to_numpy().view("u8"))).to_bytes()]})

        due.select("shard", "lo").groupBy("shard").applyInPandas(built, FILTER).unionByName(filters.where("slots is not null")).write.mode("overwrite").parquet(f"{self.root}/filters/{batch}-grown")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _filters(self, batch: int) -> DataFrame:
        grown = f"{self.root}/filters/{batch}-grown"
        return self.spark.read.schema(FILTER).parquet(grown if self._exists(grown + "/_SUCCESS") else f"{self.root}/filters/{batch}")

    def _batches(self) -> int:
        """How many batches are complete."""
        n = 0
        while self._exists(f"{self.root}/filters/{n}/_SUCCESS"):
            n += 1
        return n

    def _probed(self) -> DataFrame:
        """The postings whose keys their shard's filter holds."""
        postings = self.postings()
        most = max(1, min(POSTINGS_AT_ONCE, postings.count() // (self.shards * PART_OF_MEAN)))
        # a row for each shard
        shares = postings.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most).cast("bigint").alias("shares"))
        share = F.pmod(F.xxhash64("doc_id"), F.col("shares")).alias("share")
        asked = postings.join(F.broadcast(shares), "shard").select("shard", share, F.lit(1).alias("asks"), "hi", "lo", "doc_id", "delta", F.lit(None).cast("binary").alias("slots"))
        zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
        filters = self._filters(self._batches() - 1).join(F.broadcast(shares), "shard")
        filters = filters.select("shard", F.explode(F.sequence(zero, F.col("shares") - 1)).alias("share"), F.lit(0).alias("asks"), none.alias("hi"), none.alias("lo"), none.alias("doc_id"), F.lit(0).alias("delta"), "slots")
        dealt = asked.unionByName(filters).repartition("shard", "share").sortWithinPartitions("shard", "share", "asks")

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = -1, None
            for b in batches:
                shard, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy()
                hit = np.zeros(len(b), bool)
                # runs of rows of one shard, each filter before what asks it
                cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asks) != 0)) + 1
                for first, end in zip([0, *cuts], [*cuts, len(b)], strict=True):
                    if first == end:
                        continue
                    if not asks[first]:
                        at, held = shard[first], CuckooFilter.from_bytes(b.column("slots")[int(end) - 1].as_py())
                    elif at == shard[first]:
                        lo = b.column("lo").slice(first, end - first).to_numpy(zero_copy_only=False).astype(np.int64).view("u8")
                        hit[first:end] = held.contains(lo)
                yield b.filter(pa.array(hit)).select(["shard", "hi", "lo", "doc_id", "delta"])

        return dealt.mapInArrow(probed, POSTING)

    def duplicates(self) -> DataFrame:
        """hi, lo, doc_id of every posting whose line goes: a duplicate key in a document that isn't its last."""
        net = self._probed().groupBy("shard", "hi", "lo", "doc_id").agg(F.sum("delta").alias("sum")).where("sum > 0").drop("sum")
        held = written(net, "line-hits")
        exact = held.groupBy("shard", "hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_doc")).where(F.col("n") >= self.min_docs)
        return join_spread(held, exact, ["shard", "hi", "lo"], ["doc_id"]).where("doc_id <> last_doc").select("hi", "lo", "doc_id")

    def apply(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256, kept_text for every row of docs, which the ledger holds.

        Null and empty texts are one empty line. Rows without a doc_id keep all their lines. A text whose
        lines are all dropped becomes empty. Other columns are not read.
        """
        drops = self.duplicates().groupBy(F.col("doc_id").alias("of"), F.lit(0).alias("at")).agg(F.collect_list(F.struct("hi", "lo")).alias("drops"))
        # rows without a doc_id meet nothing, and are spread
        rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("doc_id", F.xxhash64("text")).alias("of"), F.col("doc_id").isNull().cast("int").alias("at"))
        rows = rows.join(drops, ["of", "at"], "left").select("doc_id", "text", "drops")
        min_chars = self.min_chars

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = {"doc_id": b.column("doc_id"), "n_lines": [], "n_dropped": [], "kept_sha256": [], "kept_text": []}
                for text, drops in zip(utf8(b.column("text")), b.column("drops"), strict=True):
                    lines = text.split(b"\n")
                    left = lines
                    if drops.is_valid:
                        hi, lo = (drops.values.field(k).to_numpy() for k in ("hi", "lo"))
                        gone = set(np.stack([hi, lo], 1).astype("<i8").view("V16").ravel().tolist())
                        left = [x for x in lines if key_digest(line_key(x), min_chars) not in gone]
                    joined = b"\n".join(left)
                    out["n_lines"].append(len(lines))
                    out["n_dropped"].append(len(lines) - len(left))
                    out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                    out["kept_text"].append(joined)
                yield pa.RecordBatch.from_arrays([out["doc_id"], pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept_text"], pa.binary())], list(out))

        out = rows.mapInArrow(kept, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text binary")
        return out.withColumn("kept_text", F.decode("kept_text", "UTF-8"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, **options) -> DataFrame:
    """One batch through a new ledger; see LineLedger.apply for the columns."""
    ledger = LineLedger(docs.sparkSession, shared_folder(docs.sparkSession, "line-ledger"), min_chars, min_docs, **options)
    ledger.insert(docs)
    return ledger.apply(docs)
