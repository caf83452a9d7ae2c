import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terralith.llm import common
from terralith.llm import line_dedup as dedup
from terralith.llm.common import shared_folder
from terralith.llm.line_dedup import CuckooFilter, LineLedger, key_digest, line_dedup, line_key

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_chars, least_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least_chars:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or not (len(holders[key(x)]) >= least_docs and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())


def test_against_brute_force(docs, texts):
    want = brute(texts, 40, 3)
    assert result(line_dedup(docs, 40, 3)) == want
    assert sum(k[2] * n for k, n in want.items()) > 10


def test_hot_shards_and_keys(docs, texts, monkeypatch):
    """Shards probed by many tasks, and keys dealt to many shares, give the same."""
    monkeypatch.setattr(dedup, "POSTINGS_AT_ONCE", 3)
    monkeypatch.setattr(common, "PARTS", 50)
    assert result(line_dedup(docs, 40, 3, shards=3)) == brute(texts, 40, 3)


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "PARTS", 8)
    many = [(k, i) for k, n in ((1, 90), (2, 6), (3, 1), (None, 20), (4, 2)) for i in range(n)]
    one = [(1, "x", 90), (2, "y", 6), (3, "z", 1), (9, "w", 5)]
    left, right = spark.createDataFrame(many, "k int, i int"), spark.createDataFrame(one, "k int, v string, n long")
    value = {k: v for k, v, _ in one}
    for how in ("inner", "left"):
        got = Counter((r["k"], r["i"], r["v"]) for r in common.join_spread(left, right, ["k"], ["i"], how=how).collect())
        assert got == Counter((k, i, value.get(k)) for k, i in many if how == "left" or k in value)
    assert common.join_spread(left, right.limit(0), ["k"], ["i"]).count() == 0


def test_row_hash_takes_maps(spark):
    frame = spark.sql("SELECT 1 AS a, map('x', 1) AS m, map('y', array(map(1, 2))) AS n UNION ALL SELECT 1, map('x', 2), NULL UNION ALL SELECT 1, map('x', 1), map('y', array(map(1, 2)))")
    got = [r[0] for r in frame.select(common.row_hash(frame)).collect()]
    assert len(set(got)) == 2 and all(x is not None for x in got)


def test_empty_and_unnamed(empty, unnamed):
    assert line_dedup(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in unnamed.collect()]
    assert result(line_dedup(unnamed, 5, 1)) == brute(rows, 5, 1)


def test_deletion_takes_an_insertion_back(spark, docs, texts):
    some = docs.where("doc_id % 4 = 0")
    ledger = LineLedger(spark, shared_folder(spark, "ledger"), 40, 3)
    ledger.insert(docs)
    ledger.delete(some)
    left = docs.where("doc_id % 4 <> 0")
    assert result(ledger.apply(left)) == brute([x for x in texts if x[0] % 4], 40, 3)
    ledger.insert(some)
    assert result(ledger.apply(docs)) == brute(texts, 40, 3)


def test_keys():
    assert line_key(" \x0bAbc É \r".encode()) == "abc É".encode()
    assert key_digest(("é" * 39).encode(), 40) is None and key_digest(("é" * 40).encode(), 40)
    assert re.fullmatch(r"[\x20\x09-\x0D]*", " \t\n\x0b\x0c\r")


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.integers(0, 2**32))
def test_cuckoo_filter(members, seed):
    held = CuckooFilter.of(np.array(sorted(members), np.uint64))
    again = CuckooFilter.from_bytes(held.to_bytes())
    assert again.contains(np.array(sorted(members), np.uint64)).all()
    some = sorted(members)[::2]
    again.delete(some)
    rest = np.array(sorted(members - set(some)), np.uint64)
    assert again.contains(rest).all()
    others = np.random.default_rng(seed).integers(0, 2**63, 2000, np.uint64)
    assert held.contains(others).mean() < 0.02
