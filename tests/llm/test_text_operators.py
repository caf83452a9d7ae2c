"""License scan, repeats, quality rules, near-duplicates, decontamination and token counts against brute force."""

import hashlib
import itertools
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import license_scan as scan
from terralith.llm import near_dups, repeats
from terralith.llm.common import shared_folder
from terralith.llm.components import components
from terralith.llm.decontaminate import cleaned, report, without
from terralith.llm.quality_rules import POLICIES, RULES, ablation, kept_rows, ledger, mask, verdicts
from terralith.llm.token_counts import TokenCountCache, Tokenizer, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rows(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


# licenses
def test_license_phrases(spark):
    texts = ["GNU General-Public\nLicense, and the MIT license; cc by", "mit mit license license", "CC BYE", None, "", "x " * 300 + "Apache\tLicense " * 2, "ſ K cc  by CC by"]
    got = {r["doc_id"]: r for r in scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(WORD, (t or "").translate(LOWER))
        at = [(k, label) for p, label in scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(k for k, _ in at), max(k for k, _ in at)) if at else (None, None))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) == bool(at)


def brute_templates(text, templates):
    """Labels, and the largest share, of the templates of which 4/5 of the distinct words lie in as many words as it has."""
    words, labels, best = re.findall(WORD, (text or "").translate(LOWER)), set(), 0.0
    for label, template in templates.items():
        all_ = scan.template_words(template)
        own = set(all_)
        if not own or len(own & set(words)) < 0.8 * len(own) - 1e-9:
            continue
        most = max(len(own & set(words[i : i + len(all_)])) for i in range(max(1, len(words) - len(all_) + 1)))
        if most >= 0.8 * len(own) - 1e-9:
            labels.add(label)
            best = max(best, most / len(own))
    return labels, best


def check_templates(rows_, got, templates):
    for i, t in rows_:
        labels, best = brute_templates(t, templates)
        labels |= {x for x in got[i]["base_labels"].split(",") if x}
        assert got[i]["labels"] == ",".join(sorted(labels)), i
        assert got[i]["score"] == pytest.approx(1.0 if got[i]["n_base"] else best)


def test_license_templates_against_brute_force(spark, docs, texts):
    extra = [(900 + k, f"{'pad ' * k * 7}{t} {'end ' * 50}") for k, t in enumerate(scan.TEMPLATES.values())]
    bsd = scan.TEMPLATES["bsd"]
    extra += [(950, bsd.replace("forms", "shapes").replace("permitted", "")), (951, " ".join(bsd.split()[:9])), (952, " x x x ".join(bsd.split())), (953, bsd.replace(" ", " x ", 4))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in scan.license_scan(both).collect()}
    check_templates([*texts, *extra], got, scan.TEMPLATES)
    assert all(label in got[900 + k]["labels"].split(",") for k, label in enumerate(scan.TEMPLATES)) and "bsd" not in got[952]["labels"]
    assert scan.license_scan(docs.limit(0)).count() == 0
    assert scan.license_scan(docs, templates={"none": "--"}).count() == len(texts)


def test_long_templates_at_any_place(spark):
    rng = np.random.default_rng(2)
    templates = {"long": " ".join(f"w{k}" for k in rng.integers(0, 150, 200)), "longer": " ".join(f"v{k}" for k in rng.integers(0, 900, 3000)), "word": "only"}
    rows_ = [(k, "pad " * n + templates["long"] + " end" * 9) for k, n in enumerate((0, 1, 31, 32, 100, 199, 200, 255, 256, 300, 511))]
    rows_ += [(50 + k, "pad " * n + templates["longer"]) for k, n in enumerate((0, 777, 4095))]
    for k in range(30):  # with words changed, left out or put in, about the threshold
        words = templates["long"].split()
        for _ in range(int(rng.integers(10, 200))):
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(0, 2))] = ["other"] * int(rng.integers(0, 2))
        rows_.append((100 + k, "pad " * int(rng.integers(0, 300)) + " ".join(words)))
    rows_ += [(200, "none"), (201, "Only"), (202, " ".join(templates["longer"].split()[:2500]))]
    got = {r["doc_id"]: r for r in scan.license_scan(spark.createDataFrame(rows_, "doc_id bigint, text string"), templates=templates).collect()}
    check_templates(rows_, got, templates)
    assert all(got[i]["labels"] == ("long" if i < 50 else "longer") and got[i]["score"] == 1 for i, _ in rows_[:14])
    assert 3 < sum(got[100 + k]["labels"] == "long" for k in range(30)) < 30


# repeats
def brute_repeats(texts):
    starts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - 199):
            if starts[t[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        left = bytes(b for b, h in zip(t, hit, strict=True) if not h)
        runs = sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit))
        yield len(t), sum(hit), runs, hashlib.sha256(left).hexdigest()


def test_repeats_against_brute_force(docs, texts):
    rows_ = [(i, t) for i, t in texts if len(t or "") < 50_000]
    some = docs.where(F.length(F.coalesce("text", F.lit(""))) < 50_000)
    want = Counter((i, *x) for (i, _), x in zip(rows_, brute_repeats([(t or "").encode() for _, t in rows_]), strict=True))
    assert rows(repeats.repeat_dedup(some), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(k[2] > 0 for k in want) > 5


@pytest.mark.parametrize(("at_once", "bits"), [(4096, 1 << 28), (1, 1 << 28), (4096, 1)])
def test_repeats_at_every_offset(spark, monkeypatch, at_once, bits):
    """Passages of 199 to 260 bytes, alone and in periodic text, with either way of comparing contexts, and with filters
    so full that nearly all positions pass."""
    monkeypatch.setattr(repeats, "CONTEXTS_AT_ONCE", at_once)
    monkeypatch.setattr(repeats, "BLOOM_MOST", bits)
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = []
    for size in (199, 200, 201, 215, 260):
        passage = noise(size)
        texts += [noise(int(rng.integers(0, 90))) + passage + noise(int(rng.integers(0, 90))) for _ in range(3)]
    texts += ["ab" * 300, "ab" * 110 + noise(50), noise(30) + "é" * 150, "é" * 150, "x" * 200, "x" * 200, "y" * 201]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = Counter((i, *x) for i, x in enumerate(brute_repeats([t.encode() for t in texts])))
    assert rows(repeats.repeat_dedup(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_repeats_of_unnamed_and_nothing(empty, unnamed):
    assert repeats.repeat_dedup(empty).count() == 0
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.repeat_dedup(unnamed).collect()}
    assert got == {(None, 420): 420, (None, 0): 0, (5, 0): 0}


def test_repeats_of_texts_under_one_id(spark):
    """Texts under one doc_id, and without one, are told apart."""
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = noise(230)
    texts = [noise(50) + passage + noise(300), noise(400), passage + noise(90), noise(77) + passage, noise(500), noise(300)]
    ids = [7, 7, 7, None, None, None]
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    want = Counter((i, *x) for i, x in zip(ids, brute_repeats([t.encode() for t in texts]), strict=True))
    assert rows(repeats.repeat_dedup(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


# quality rules
def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality_against_brute_force(docs, texts, spark, unnamed):
    extra = [(1000, "a b c d e a b c d e a"), (1001, "#" * 9), (1002, "x\ny\nx\nx\nx z\n\n \n"), (1003, "\x0bword\x85next\xa0one two"), (1004, "one two three four five " * 400)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string")).union(unnamed.select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    pairs = [*texts, *extra, *((r["doc_id"], r["text"]) for r in unnamed.collect())]
    assert rows(ledger(both), "doc_id", *names) == Counter((i, *brute_quality(t)) for i, t in pairs)
    for r in verdicts(both).collect():
        m = dict(zip(names, (r[n] for n in names), strict=True))
        failed = [name for name, (bit, _) in RULES.items() if r["fail_bits"] >> bit & 1]
        assert r["base_failed"] == (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"])
        assert r["kept"] == (not failed) and not (r["base_failed"] and r["kept"])
    kept = verdicts(both).where("kept")
    assert rows(kept_rows(both), "doc_id", "text") == rows(both.join(kept.select("doc_id").distinct(), "doc_id"), "doc_id", "text")


def test_ablation(docs, empty):
    entries = ledger(docs)
    bits = [r[0] for r in entries.select("fail_bits").collect()]
    for version in POLICIES:
        got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in ablation(entries, version).collect()}
        for name in POLICIES[version]:
            bit = 1 << RULES[name][0]
            own = [b & mask(version) for b in bits]
            assert got[name] == (sum(b & bit > 0 for b in own), sum(b == bit for b in own), sum(b & ~bit == 0 for b in own))
    assert ledger(empty).count() == 0


# near-duplicates
def brute_components(rows_, size, percent):
    sets = {}
    for i, t in rows_:
        w = (t or "").translate(LOWER)
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(docs, texts, size):
    want = brute_components(texts, size, 80)
    got = near_dups.near_duplicates(docs, size, 80).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_near_duplicates_in_a_chain(spark):
    """Each text is linked with the next only, in one group that no hub holds together."""
    base = [f"t{k}" for k in range(400)]
    texts = [" ".join(base[15 * k : 15 * k + 200]) for k in range(12)]
    frame = spark.createDataFrame([(100 - k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    want = brute_components([(100 - k, t) for k, t in enumerate(texts)], 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(frame, 2, 80).collect()} == want


def test_near_duplicates_of_unnamed_and_nothing(empty, unnamed):
    assert near_dups.near_duplicates(empty).count() == 0
    got = near_dups.near_duplicates(unnamed).collect()
    assert all(r["kept"] for r in got) and {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (5, 5)}


def test_estimate_is_corrected():
    rng = np.random.default_rng(3)
    for common, own in ((800, 100), (200, 400), (0, 500)):
        errors = []
        for _ in range(20):
            x = rng.integers(0, 2**63, common + 2 * own, np.uint64)
            a, b = np.unique(x[: common + own]), np.unique(np.concatenate([x[:common], x[common + own :]]))
            errors.append(near_dups.estimate(near_dups.sketch(a)[None], near_dups.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0] - common / (common + 2 * own))
        assert abs(np.mean(errors)) < 0.03


def test_blocks_of_near_copies_in_bounded_memory():
    """Sets of one group of near copies have nearly all elements in common, a hundred million here."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.08, rng.integers(0, 2**63, 300, np.uint64), base)) for _ in range(1000)]
    tracemalloc.start()
    common = near_dups._counts(sets[:600], sets[600:])
    most = tracemalloc.get_traced_memory()[1] - common.nbytes
    tracemalloc.stop()
    assert most < 20e6
    for i, j in rng.integers(0, 400, (50, 2)):
        assert common[i, j] == len(np.intersect1d(sets[i], sets[600 + j]))


@pytest.mark.parametrize("rows_, elements", [(128, 1 << 18), (3, 700)])
def test_links_of_a_block_against_brute_force(monkeypatch, rows_, elements):
    monkeypatch.setattr(near_dups, "ROWS_AT_ONCE", rows_)
    monkeypatch.setattr(near_dups, "ELEMENTS_AT_ONCE", elements)
    r = np.random.default_rng(6)
    texts_ = []
    for _ in range(60):
        words = [f"g{k}" for k in range(200)]
        for k in r.integers(0, 200, r.integers(0, 8)):
            words[k] = f"x{r.integers(0, 10**6)}"
        texts_.append(" ".join(words).encode())
    sets = [near_dups.shingle_set(t, 2, near_dups._WordHashes()) for t in texts_]
    all_ = [(i, i, len(x), near_dups.sketch(x).tobytes(), t) for i, (x, t) in enumerate(zip(sets, texts_, strict=True))]
    apart = near_dups._Apart(2, 90)
    apart.rows = all_[:30]
    for a, b in apart.links(all_[30:]):
        common = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common)
    want = {i: i for i in range(60)}
    for a, b in itertools.product(range(30), range(30, 60)):
        common = len(np.intersect1d(sets[a], sets[b]))
        if 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
            x, y = min(want[a], want[b]), max(want[a], want[b])
            want = {k: x if v == y else v for k, v in want.items()}
    assert {i: apart.root(i) for i in range(60)} == want
    assert 1 < len(set(want.values())) < 60


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (7, 9), *((20 + k, 21 + k) for k in range(40))]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 8: 7, 9: 7, **{21 + k: 20 for k in range(40)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# decontamination
def brute_report(text, items, n):
    words = re.findall(WORD, (text or "").translate(LOWER))
    hit, held = set(), set()
    for item, t in items:
        w = re.findall(WORD, (t or "").translate(LOWER))
        size = min(n, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                held |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    long = [t for _, t in texts if t and 200 < len(t) < 5000]
    items = [(k, " ".join(t.split()[3:30])) for k, t in enumerate(long[:8])] + [(100, "changed"), (101, "The W1"), (102, None), (103, "--"), (104, long[0]), (100, "changed"), (None, "of w1 a")]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def test_decontamination_against_brute_force(docs, texts, benchmark, empty, unnamed):
    items, frame = benchmark
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = Counter((i, *brute_report(t, items, 10)) for i, t in texts)
    assert rows(report(docs, frame), *names) == want
    assert report(empty, frame).count() == 0 and report(unnamed, frame).count() == 3
    assert not report(docs, frame.limit(0)).where("contaminated").count()


def test_decontamination_in_blocks(docs, benchmark):
    from terralith.llm.decontaminate import hits

    one = hits(docs.select("doc_id", "text"), benchmark[1])
    many = hits(docs.select("doc_id", "text"), benchmark[1], most_words=60)
    as_rows = lambda df: sorted((r["doc_id"], r["n_words"], str(r["spans"]), str(r["items"])) for r in df.collect())
    assert as_rows(one) == as_rows(many)


def test_cleaning(spark, docs, benchmark):
    assert without("One, two; (three) four.", [(1, 2)]) == "One, ) four."
    items, frame = benchmark
    out = cleaned(docs, frame)
    assert out.columns == docs.columns
    again = report(out, frame.where("item_id < 100"))
    assert report(docs.where("doc_id < 0"), frame).count() == 0
    assert again.where("contaminated").count() == 0
    clean = report(docs, frame).where("not contaminated").select("doc_id")
    kept = out.join(clean, "doc_id").select("doc_id", "text", "n_chars")
    assert rows(kept, "doc_id", "text", "n_chars") == rows(docs.join(clean, "doc_id"), "doc_id", "text", "n_chars")
    assert out.where("text is not null and n_chars <> length(text)").count() == 0


def test_rows_pass_through_python_once(docs, benchmark, capsys):
    """Each pass takes a Python worker for each core, with its memory."""
    cleaned(docs, benchmark[1]).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_cleaning_against_brute_force(docs, texts, benchmark):
    """Which documents go, and which change."""
    items, frame = benchmark
    want = Counter()
    for i, t in texts:
        n, hit = brute_report(t, items, 10)[:2]
        if hit < 0.2 * max(n, 1):
            want[i, n - hit] += 1
    got = Counter((r["doc_id"], len(re.findall(WORD, (r["text"] or "").translate(LOWER)))) for r in cleaned(docs, frame).collect())
    assert got == want and 0 < sum(want.values()) < len(texts)
    assert Counter((r["doc_id"], r["text"]) for r in cleaned(docs, frame, most_words=60).collect()) == Counter((r["doc_id"], r["text"]) for r in cleaned(docs, frame).collect())


# token counts
@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts(spark, docs, texts, empty, unnamed, model_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    want = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 20) for i, t in texts)
    got = token_counts(docs, shared_folder(spark, "tokens"), model_path, limit=20)
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts(empty, shared_folder(spark, "tokens"), model_path).count() == 0
    assert rows(token_counts(unnamed, shared_folder(spark, "tokens"), model_path), "doc_id") == Counter({(None,): 2, (5,): 1})


def test_only_misses_are_encoded(spark, docs, texts, model_path):
    cache = TokenCountCache(spark, shared_folder(spark, "tokens"), Tokenizer(model_path))
    first = rows(cache.counts(docs.where("doc_id < 30")), "doc_id", "n_tokens")
    before = rows(cache.stored(), "digest", "n_tokens")
    both = rows(cache.counts(docs), "doc_id", "n_tokens")
    after = rows(cache.stored(), "digest", "n_tokens")
    assert not first - both and not before - after
    assert sum(after.values()) == len({t or "" for _, t in texts})
    files = spark.read.parquet(cache.path).count()
    cache.counts(docs).collect()
    assert spark.read.parquet(cache.path).count() == files
