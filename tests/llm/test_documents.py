"""Document operators against plain-Python versions, on awkward rows and on the small test tables."""

from __future__ import annotations

import hashlib
import importlib.util
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pubmeta.llm import common, exact, katz, minhash, mixing, packing, shards

_spec = importlib.util.spec_from_file_location("llm_helpers", os.path.join(os.path.dirname(__file__), "helpers.py"))
h = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(h)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(given):
    return {r["doc_id"]: r["text"] for r in given.select("doc_id", "text").collect()}


# exact duplicates


@pytest.mark.parametrize("bits", [8, 15, 20])
def test_filters_merge_without_loss(bits):
    rng = np.random.default_rng(1)
    parts = [np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(2)]
    parts[1][:50] = parts[0][:50]
    merged = Counter()
    for part in parts:
        keys, n = np.unique(part, return_counts=True)
        for row in exact._encode(keys, n, bits):
            got, counts = exact._decode(*row, bits)
            merged.update(dict(zip(got.tolist(), counts.tolist(), strict=True)))
    assert merged == Counter(np.concatenate(parts).tolist())


def test_exact_duplicates_of_awkward_rows(spark):
    rows = exact.exact_duplicates(h.documents(spark)).collect()
    docs = h.documents(spark).select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for d in docs:
        by[re.sub(r"[\x20\x09-\x0D]+", "", d["text"] or "")].append((-len(d["text"] or ""), d["doc_id"] is None, d["doc_id"]))
    want = Counter()
    for norm, group in by.items():
        keep = min(group, key=lambda g: (g[0], g[1], g[2] or 0))[2]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        want.update((g[2], keep, len(group), g[2] == keep, sha) for g in group)
    assert Counter(tuple(r) for r in rows) == want


def test_distinct_texts_keeps_one_row_of_each_text(spark):
    docs = h.documents(spark)
    kept = exact.distinct_texts(docs)
    assert kept.columns == docs.columns
    norms = [re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "") for r in kept.collect()]
    assert len(norms) == len(set(norms))
    assert set(norms) == {re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "") for r in docs.collect()}


def test_blocks_grow_with_the_rows():
    assert exact.block_bits(0) == exact.block_bits(200 << 20) == 8
    assert (20_000_000_000 >> exact.block_bits(20_000_000_000)) <= exact.BLOCK_ROWS


def test_merging_adds_up_counts():
    parts = [np.array(x, np.uint64) for x in ([1, 5, 9], [5, 9, 12], [9])]
    keys, n = exact._merge(parts, [np.array([1, 2, 1]), np.array([1, 1, 4]), np.array([7])])
    assert keys.tolist() == [1, 5, 9, 12] and n.tolist() == [1, 3, 9, 4]


CLASH = ("_sha", "_key", "_nth", "_first", "_second", "_order", "_times", "_name", "_copy", "_row", "_id", "fingerprint", "rows")


def _clashing(spark):
    rows = [(1, "a b", "x"), (2, "ab", "x"), (3, "ab ", "y"), (3, "ab ", "y"), (4, None, None), (None, "c", "x"), (None, "c", "x")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, n long")
    return df.withColumns({c: F.concat(F.lit("mine"), F.col("n")) for c in CLASH}), len(rows)


@pytest.mark.parametrize(
    "stage", [exact.distinct_texts, minhash.distinct_documents, mixing.mixed_rows], ids=["exact", "near", "mixing"]
)
@pytest.mark.parametrize("small", [0, 1000])
def test_stages_leave_clashing_columns_alone(spark, stage, small, monkeypatch):
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    docs, _ = _clashing(spark)
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"mine{r['n']}" for c in CLASH)


@pytest.mark.parametrize("small", [0, 1000])
def test_distinct_texts_of_repeated_rows(spark, small, monkeypatch):
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    docs, _ = _clashing(spark)
    kept = [(r["doc_id"], r["text"]) for r in exact.distinct_texts(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(1, "a b"), (4, None), (None, "c")], key=repr)


# near duplicates


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    for n in (3, 40, 600, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(minhash.estimate(minhash.sketch(a).tobytes(), minhash.sketch(b).tobytes()) - true) < 0.09
    assert (minhash.sketch(a) == minhash.sketch(np.sort(a))).all()


def test_shingles_are_those_of_the_words():
    found = minhash.shingle_sets(pa.array([t or "" for t in h.TEXTS]), 4)
    assert [len(s) for s in found] == [len(h.shingles(t, 4)) for t in h.TEXTS]
    assert (found[4] == found[5]).all() and (found[5] == found[6]).all()


def test_near_duplicates_of_awkward_rows(spark):
    rows = minhash.near_duplicates(h.documents(spark), words=4).collect()
    want = h.near_components(dict(enumerate(h.TEXTS)), 4)
    assert len(rows) == h.documents(spark).count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            text = h.TEXTS[r["doc_id"]]
            assert (r["n_shingles"], r["component_id"]) == (len(h.shingles(text, 4)), want[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_a_group_around_one_original(spark):
    """Copies that are near their original but not each other, which has the largest id, and a chain."""
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for k in range(30):
        copy = list(base)
        copy[3 * k] = f"edit{k}"
        copy[(3 * k + 50) % 100] = f"more{k}"
        texts[k] = " ".join(copy)
    texts[30] = " ".join(base)
    for k in range(8):
        texts[40 + k] = " ".join(f"c{i}" for i in range(9 * k, 9 * k + 90))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words=4).collect()}
    assert got == h.near_components(texts, 4)


def test_near_duplicates_of_the_test_table(spark, given, texts):
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(given, words=4).collect()}
    assert got == h.near_components(texts, 4)


# language model


def _katz(train: list[list[str]], order: int = 3):
    count = [Counter() for _ in range(order + 1)]
    for t in train:
        for n in range(1, order + 1):
            count[n].update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    total = sum(count[1].values())
    factor = [[0, *katz.discounts(dict(Counter(c.values()))), 1] for c in count]
    freed = sum(c * (1 - factor[1][min(c, 6)]) for c in count[1].values())
    after = [defaultdict(list) for _ in range(order + 1)]
    for n in range(2, order + 1):
        for gram, c in count[n].items():
            if c >= katz.LEAST_COUNT:
                after[n][gram[:-1]].append(gram)
    known = {}

    def p(gram):
        n = len(gram)
        c = count[n][gram]
        if n == 1:
            return factor[1][min(c, 6)] * c / total if c else freed / total
        past = gram[:-1]
        if not after[n][past]:
            return p(gram[1:])
        m = count[n - 1][past]
        if past not in known:
            high = sum(factor[n][min(count[n][g], 6)] * count[n][g] / m for g in after[n][past])
            low = sum(p(g[1:]) for g in after[n][past])
            left = 1 - high
            known[past] = ((left if left > 1e-9 else 1 / (m + 1)) / (1 - low), 1 if left > 1e-9 else m / (m + 1))
        weight, scale = known[past]
        return scale * factor[n][min(c, 6)] * c / m if c >= katz.LEAST_COUNT else weight * p(gram[1:])

    return p, count, total


def test_katz_scores_of_the_test_table(spark, given, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*h.words(t), "\n"] for i, t in texts.items()}
    p, count, total = _katz([t for i, t in tokens.items() if not held[i]])
    expression = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    for r in katz.katz_scores(given, expression).collect():
        t = tokens[r["doc_id"]]
        want = sum(math.log10(p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(len(t)))
        base = sum(math.log10((count[1][w,] + 1) / (total + len(count[1]) + 1)) for w in t)
        assert math.isclose(r["score"], want, rel_tol=1e-7) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["n_tokens"], r["train_tokens"]) == (len(t), total)
        assert r["n_known"] == sum((w,) in count[1] for w in t) and r["held_out"] == held[r["doc_id"]]


@pytest.mark.parametrize("parts", [1, 7])
def test_katz_counts_what_occurs_once(spark, given, texts, parts, monkeypatch):
    """The brute force has no cut; in several blocks some n-grams are shared and some are in one block alone."""
    monkeypatch.setattr(katz, "LEAST_COUNT", 1)
    tokens = {i: [*h.words(t), "\n"] for i, t in texts.items()}
    p, count, _ = _katz([t for i, t in tokens.items() if i % 5])
    assert sum(c == 1 for c in count[3].values()) > len(count[3]) / 2
    rows = katz.katz_scores(given.repartition(parts), F.col("doc_id") % 5 == 0).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert math.isclose(r["score"], sum(math.log10(p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(len(t))), rel_tol=1e-7)


def test_backoff_is_normalised():
    train = [t.split() + ["\n"] for t in ("a b a b c", "a b d", "b c a b", "d d d d d d d d", "c a b a b")]
    p, count, _ = _katz(train)
    unknown = ("never",)
    for past in [("a",), ("b",), ("a", "b"), ("d", "d"), ("never",)]:
        assert math.isclose(sum(p((*past, w)) for (w,) in count[1]) + p((*past, *unknown)), 1, rel_tol=1e-9)


def test_katz_scores_of_awkward_rows(spark):
    docs = h.documents(spark)
    rows = katz.katz_scores(docs, F.col("doc_id") == 5).collect()
    assert len(rows) == docs.count()
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)} == {1}
    none = katz.katz_scores(docs, F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.0} and {r["train_tokens"] for r in none} == {0}


def test_one_id_with_two_texts(spark):
    """Text A of document 5 is near document 1, text B is like nothing else, and C and D of document 7 make a component."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a + " more"), (5, a), (5, b), (7, c), (7, c + " end"), (9, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, words=4).collect())
    assert got == {(1, 58, 1, True): 1, (5, 57, 1, False): 1, (5, 57, 5, True): 1, (7, 57, 7, True): 1, (7, 58, 7, True): 1, (9, 57, 7, False): 1}
    left = Counter(tuple(r) for r in minhash.distinct_documents(docs, words=4).collect())
    assert left == Counter([rows[0], rows[2], rows[3], rows[4]])


# packing


def _check_packing(pieces, texts: dict):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    own, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(own[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and 0 < r["length"] <= 1024
            assert k == 0 or r["length"] == 1024
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(own[i]) == 1)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_packing_of_the_test_table(spark, given, texts):
    pieces = packing.packed_sequences(given).collect()
    bound = -(-sum(r["length"] for r in pieces) // 1024)
    assert _check_packing(pieces, texts) <= bound + 2


def test_packing_of_awkward_rows(spark):
    docs = h.documents(spark)
    pieces = packing.packed_sequences(docs).collect()
    once = [r for r in pieces if r["doc_id"] is not None]
    assert sum(r["doc_id"] == 7 for r in once) == 2 and sum(r["doc_id"] is None for r in pieces) == 2
    alone = h.documents(spark, extra=False)
    _check_packing(packing.packed_sequences(alone).collect(), dict(enumerate(h.TEXTS)))


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400)
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, gap in enumerate(bins) if gap >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(64 - n)
    plan = packing.best_fit(dict(Counter(lengths.tolist())), 64)
    used = defaultdict(int)
    for length, matches in plan.items():
        ends = 0
        for lo, hi, first, per, offset in matches:
            assert lo == ends
            ends = hi
            for rank in range(lo, hi):
                b = first + (rank - lo) // per
                assert used[b] == offset + (rank - lo) % per * length
                used[b] += length
        assert ends == (lengths == length).sum()
    assert max(used.values()) <= 64 and len(used) == len(bins)


# mixing


def test_targets_share_out_what_is_cut():
    sizes = {"a": 10, "b": 1000, "c": 5, None: 100}
    got = mixing.target_shares(sizes)
    assert math.isclose(sum(got.values()), sum(sizes.values())) and got["c"] == 15
    assert all(t <= 3 * sizes[s] + 1e-9 for s, t in got.items())
    assert mixing.target_shares({}) == {}


@pytest.mark.parametrize("seed", range(20))
def test_fit_is_as_near_as_any_subset(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(0, 40, 5))
    counts = rng.integers(1, 4, len(lengths))
    total = int((lengths * counts).sum())
    budget = int(rng.integers(0, total + 1))
    taken = mixing.fit_lengths(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    sums = {0}
    for n, k in zip(lengths.tolist(), counts.tolist(), strict=True):
        sums = {s + n * j for s in sums for j in range(k + 1)}
    # the proportional part is fixed, so the nearest subset may be missed by less than the shortest document
    assert abs(int((lengths * taken).sum()) - budget) <= min(abs(s - budget) for s in sums) + lengths.max()


def test_fit_overshoots_where_that_is_nearer():
    fit = lambda lengths, counts, budget: mixing.fit_lengths(np.array(lengths), np.array(counts), budget).tolist()
    assert fit([1000], [1], 900) == [1] and fit([1000], [1], 500) == [0] and fit([1000], [1], 400) == [0]
    assert fit([100_000], [3], 270_000) == [3] and fit([100_000], [3], 240_000) == [2]
    assert fit([30, 1000], [1, 1], 940) == [0, 1]


@pytest.mark.parametrize("seed", range(40))
def test_fit_is_the_nearest_with_the_proportional_part(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 400, 4))
    counts = rng.integers(1, 4, len(lengths))
    total = int((lengths * counts).sum())
    budget = int(rng.integers(1, total + 1))
    sums = {0}
    for n, k, least in zip(lengths.tolist(), counts.tolist(), (counts * budget // total).tolist(), strict=True):
        sums = {s + n * j for s in sums for j in range(least, k + 1)}
    taken = mixing.fit_lengths(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    assert abs(int((lengths * taken).sum()) - budget) == min(abs(s - budget) for s in sums)


@pytest.mark.parametrize("seed", range(20))
def test_fit_of_a_source_does_not_depend_on_the_order_of_its_cells(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 400, 12))
    cells = pd.DataFrame({"source": "s", "size": lengths, "rows": rng.integers(1, 5, len(lengths))})
    size = int((cells["size"] * cells["rows"]).sum())
    run = mixing._fit_source({"s": size * float(rng.uniform(0.1, 2.9))}, {"s": size})
    want = run(cells).reset_index(drop=True)
    for _ in range(5):
        pd.testing.assert_frame_equal(run(cells.sample(frac=1, random_state=int(rng.integers(1 << 30)))).reset_index(drop=True), want)


def test_mix_of_repeated_rows_and_two_sources(spark):
    """Rows that repeat everything share what is taken of them; a document under two sources follows each."""
    rows = [(1, "a b c", "x")] * 7 + [(2, "a b c d e", "x"), (1, "a b c", "y"), (3, "f g", "y"), (4, "h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for partitions in (1, 4):
        given = docs.repartition(partitions)
        taken = mixing.mixed_documents(given).collect()
        assert len(taken) == len(rows)
        total = sum(r["times"] for r in taken)
        by_id = Counter()
        for r in taken:
            by_id[r["doc_id"]] += r["times"]
        mixed = mixing.mixed_rows(given).collect()
        assert len(mixed) == total and Counter(r["doc_id"] for r in mixed) == by_id
        per_source = Counter()
        for r in mixed:
            per_source[r["source"]] += len(r["text"].split())
        targets = mixing.target_shares({"x": 26, "y": 5, None: 1})
        assert all(abs(per_source[s] - t) <= 5 for s, t in targets.items())


def _check_mix(rows, texts: dict, sources: dict):
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        n = len(h.words(texts[r["doc_id"]]))
        assert r["size"] == n and r["taken"] in {0, n, 2 * n, 3 * n}
        s = by[sources[r["doc_id"]]]
        s[0] += r["taken"]
        s[1], s[2] = r["target"], r["source_size"]
    return by


def test_mix_of_the_test_table(spark, given, texts):
    sources = {r["doc_id"]: r["source"] for r in given.select("doc_id", "source").collect()}
    rows = mixing.mixed_documents(given).collect()
    for taken, target, size in _check_mix(rows, texts, sources).values():
        assert abs(taken - target) <= max(40, 0.02 * target) and target <= 3 * size + 1e-6
    again = mixing.mixed_documents(given.repartition(5)).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    for partitions in (3, 11):
        again = mixing.mixed_documents(given.repartition(partitions, "text")).collect()
        assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    mixed = mixing.mixed_rows(given)
    assert mixed.columns == given.columns
    counts = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert counts == Counter({r["doc_id"]: r["times"] for r in rows if r["times"]})


def test_mix_of_awkward_rows(spark):
    docs = h.documents(spark)
    rows = mixing.mixed_documents(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mixed_rows(docs).count() == sum(r["times"] for r in rows)


# sharding


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(4)
    for _ in range(20):
        old = rng.integers(0, 1000, 6).tolist()
        capacity = shards.even_capacities(sum(old), 6)
        flow = shards.transfers(old, capacity)
        assert [sum(row) for row in flow] == old and [sum(c) for c in zip(*flow, strict=True)] == capacity
        moved = sum(flow[i][j] for i in range(6) for j in range(6) if i != j)
        assert moved == sum(max(0, o - c) for o, c in zip(old, capacity, strict=True))
    # a cost that makes the direct way dear: the flow goes the cheap way and back
    assert shards.min_cost_flow([2, 1], [1, 2], [[0, 5], [1, 2]]) in ([[1, 1], [0, 1]], [[0, 2], [1, 0]])


def test_resharding(spark, given, texts, tmp_path):
    old = F.pmod(F.col("doc_id"), F.lit(11)) % 4
    placed = shards.resharded(given, old, 4)
    rows = placed.collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 4
    assert all(abs(n - mean) < 0.02 * mean for n in sizes.values())
    path = str(tmp_path / "shards")
    given.withColumn("shard", old).write.partitionBy("shard").parquet(path)
    written = shards.write_shards(given, placed, path)
    assert written
    now = {r["doc_id"]: r["shard"] for r in spark.read.parquet(path).collect()}
    assert now == {r["doc_id"]: r["shard"] for r in rows}


def test_affected_shards_are_written_whole(spark, tmp_path):
    """Null and repeated ids, and a shard that loses all its rows."""
    rows = [(None if i % 5 == 0 else i % 7, f"text {i} " * (i % 11), f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    old = F.when(F.col("doc_id") == 6, 1).otherwise(0)
    path = str(tmp_path / "shards")
    docs.withColumn("shard", old).write.partitionBy("shard").parquet(path)
    total = sum(len(t) + 1 for _, t, _ in rows)
    written = shards.write_shards(docs, shards.resharded(docs, old, 2, [total, 0]), path)
    assert written == [0, 1]
    found = spark.read.parquet(path).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in found) == Counter(rows)
    assert {r["shard"] for r in found} == {0}
    path = str(tmp_path / "fresh")
    got = shards.resharded_files(docs, old, path, 3).collect()
    want = Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    files = spark.read.parquet(path).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in files) == Counter(rows)
    slots = {s: sorted(r["slot"] for r in files if r["shard"] == s) for s in range(3)}
    assert all(x and x == list(range(len(x))) for x in slots.values())


def test_files_keep_columns_of_any_name(spark, tmp_path):
    rows = [(i, f"text {i}", f"shard {i}", i, f"old {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, old_shard string")
    got = shards.resharded_files(docs, F.lit(0), str(tmp_path / "s"), 4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(40)) and {r["shard"] for r in got} == {0, 1, 2, 3}
    files = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r["doc_id"], r["text"], r["shard"], r["slot"], r["old_shard"]) for r in files) == rows
    assert {r["doc_id"]: r["_shard"] for r in files} == {r["doc_id"]: r["shard"] for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_rows_move_as_few_bytes_as_the_flow(spark, seed):
    """Bytes of moved rows equal those of the flow, up to a row at each border between transfers."""
    rng = np.random.default_rng(seed)
    rows = [(i, "x" * int(rng.integers(0, 200)), int(rng.choice(4, p=[0.6, 0.2, 0.1, 0.1]))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    placed = shards.resharded(docs, F.col("at"), 4).collect()
    old = [sum(len(t) + 1 for _, t, s in rows if s == k) for k in range(4)]
    flow = shards.transfers(old, shards.even_capacities(sum(old), 4))
    least = sum(flow[i][j] for i in range(4) for j in range(4) if i != j)
    assert least == sum(max(0, o - c) for o, c in zip(old, shards.even_capacities(sum(old), 4), strict=True))
    moved = Counter()
    for r in placed:
        moved[r["old_shard"], r["shard"]] += r["size"]
    borders = sum(bool(x) for line in flow for x in line)
    assert abs(sum(n for (a, b), n in moved.items() if a != b) - least) <= 201 * borders
    for i in range(4):
        for j in range(4):
            assert abs(moved[i, j] - flow[i][j]) <= 2 * 201


def test_resharding_of_awkward_rows(spark):
    docs = h.documents(spark)
    rows = shards.resharded(docs, F.col("doc_id") % 3, 3).collect()
    assert len(rows) == docs.count()
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {1}


# all of them


@pytest.mark.parametrize(
    "run",
    [
        exact.exact_duplicates,
        exact.distinct_texts,
        minhash.near_duplicates,
        minhash.distinct_documents,
        lambda d: katz.katz_scores(d, F.lit(False)),
        packing.packed_sequences,
        mixing.mixed_documents,
        mixing.mixed_rows,
        lambda d: shards.resharded(d, F.lit(0)),
    ],
)
def test_empty_tables(spark, run):
    assert run(h.empty(spark)).count() == 0
