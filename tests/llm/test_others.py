"""Vectors, URLs, conversations, toxicity and the pipeline."""

from __future__ import annotations

import importlib.util
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubmeta.llm import caps, chat, toxicity, urls
from pubmeta.llm.components import connected_components
from pubmeta.llm.common import Scratch
from pubmeta.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

_spec = importlib.util.spec_from_file_location("llm_helpers", os.path.join(os.path.dirname(__file__), "helpers.py"))
h = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(h)

FOLDER = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (20, 10), (10, 15), (15, 12), (12, 30), (30, 4), (6, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    want = h.components(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if k != 7}


# vectors


def _brute(rows, cosine=0.93):
    links, edges = Counter(), []
    unit = {}
    for i, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            unit[i] = (x / np.linalg.norm(x), label)
    for i, (x, a) in unit.items():
        for j, (y, b) in unit.items():
            if i < j and a == b and len(x) == len(y) and x @ y >= cosine:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    return links, h.components(edges, [r[0] for r in rows])


def test_decoding_lists_exactly_the_filters_in_the_cap():
    rng = np.random.default_rng(3)
    turn, codes, threshold = caps.product_codes(64)
    for _ in range(5):
        v = rng.standard_normal(64)
        v /= np.linalg.norm(v)
        turned = turn @ v
        scores = [((a @ turned[p][:32])[:, None] + (b @ turned[p][32:])[None, :]).ravel() for p, a, b in codes]
        scores = np.concatenate(scores) / np.sqrt(2)
        want = np.flatnonzero(scores >= threshold)
        if len(want) < caps.LEAST_FILTERS:
            want = np.sort(np.argsort(-scores, kind="stable")[: caps.LEAST_FILTERS])
        assert caps.decode(v).tolist() == want.tolist()


def _vectors(kind: str, dim: int, rng) -> np.ndarray:
    x = rng.standard_normal(dim)
    if kind == "dominated":
        x[rng.integers(dim)] = 0
        x /= np.linalg.norm(x)
        x *= np.sqrt(0.1)
        x[np.flatnonzero(x == 0)[0]] = np.sqrt(0.9)
    elif kind in ("two", "four"):
        keep = rng.choice(dim, 2 if kind == "two" else 4, replace=False)
        x = np.where(np.isin(np.arange(dim), keep), x, 0)
    return x / np.linalg.norm(x)


@pytest.mark.parametrize("dim", [8, 64, 256, 768])
@pytest.mark.parametrize("kind", ["dense", "dominated", "two", "four"])
def test_recall_at_the_threshold(kind, dim):
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(150):
        x = _vectors(kind, dim, rng)
        y = rng.standard_normal(dim)
        y = np.where(x != 0, y, 0) if kind in ("two", "four") else y
        y -= (y @ x) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y)
        met += bool(len(np.intersect1d(caps.decode(x), caps.decode(y))))
    assert met >= 0.985 * 150


def test_vectors_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(64)
        for _ in range(25):
            v = centre + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.3])
            rows.append((len(rows), v.tolist(), c % 2))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(4)]
    n = len(rows)
    odd = [None, [], [0.0] * 64, [1.0, None], [float("nan")] * 64, [float("inf")] * 64, [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 50, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    monkeypatch.setattr(caps, "PIECE", 7)
    got = {r["vec_id"]: r for r in caps.near_vectors(df).collect()}
    links, component = _brute(rows)
    assert len(got) == len(rows)
    assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in got}
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_one_id_with_two_vectors(spark):
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((2, 64))
    rows = [(1, x), (5, x + 0.05 * y), (5, y), (6, y + 0.05 * x), (8, y - 0.05 * x)]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in caps.near_vectors(df).collect())
    assert got == {(1, 1, 1, True): 1, (5, 1, 1, False): 1, (5, 2, 5, True): 1, (6, 2, 5, False): 1, (8, 2, 5, False): 1}


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert caps.near_vectors(df).count() == 0
    df = spark.createDataFrame([(None, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r["vec_id"] or -1, r["n_links"]) for r in caps.near_vectors(df).collect()) == [(-1, 0), (3, 1), (3, 1)]


# URLs

URLS = [
    ("https://WWW.Example.ORG/es/7?x=1#y", "www.example.org", "/es/7", "example.org/es/", "block"),
    ("https://a.example.org/en/19", "a.example.org", "/en/19", "example.org/en/1", "block"),
    ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("http://x.example.com/fr/1", "x.example.com", "/fr/1", "com/fr/", "allow"),
    ("http://x.example.com/de/1", "x.example.com", "/de/1", "com/de/", "block"),
    ("http://org", "org", "", None, None),
    ("http://org/", "org", "/", "org/", "allow"),
    ("http://notorg/", "notorg", "/", None, None),
    ("http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
    ("no scheme.org/es/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("x://", "", "", None, None),
    ("http://é.net?q=1/2", "é.net", "", None, None),
    ("http://long.net/" + "a1/" * 20_000, "long.net", "/" + "a1/" * 20_000, None, None),
]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judged_urls(df.withColumn("host", F.lit("x")), URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def test_trees_learn_from_lexical_features(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        bad = i % 2
        digits = "".join(rng.choice(list("0123456789"), 30)) if bad else "".join(rng.choice(list("abcdef"), 12))
        rows.append((i, f"http://h{i % 7}.{'net' if i % 3 else 'com'}/{'x' if i < 500 else 'y'}{'bad' if bad else 'good'}/{digits}"))
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = [(f"{tld}/x{name}/", say) for tld in ("com", "net") for name, say in (("bad", "block"), ("good", "allow"))]
    got = {r["page_id"]: r for r in urls.judged_urls(df, rules).collect()}
    later = [i for i in range(500, 600)]
    assert all(got[i]["rule"] is None for i in later)
    assert sum(got[i]["verdict"] == ("block" if i % 2 else "allow") for i in later) >= 90


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged_urls(df, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/"), (None, "http://b.org/")], "page_id long, url string")
    assert {r["verdict"] for r in urls.judged_urls(one, URL_RULES).collect()} == {"allow"}


# conversations

TURNS = "pair_id long, side string, turn long, role string, text string"


def test_prompt_is_the_longest_common_prefix(spark):
    rows = [(1, s, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for s in ("chosen", "rejected") for i in range(3)]
    rows += [(1, "chosen", 3, "assistant", "good"), (1, "rejected", 3, "assistant", "bad"), (1, "rejected", 4, "user", None)]
    rows += [rows[0], (2, "chosen", 0, None, None), (2, "rejected", 0, None, None), (3, "chosen", None, "assistant", "x")]
    rows += [(None, "chosen", 0, "user", "a"), (None, "rejected", 0, "user", "b"), (4, "other", 0, "user", "a")]
    df = spark.createDataFrame(rows, TURNS).withColumn("cut", F.lit("x"))
    segments = chat.preference_segments(df)
    by = {}
    for r in segments.orderBy("pair_id", "part", "turn").collect():
        by.setdefault((r["pair_id"], r["part"]), []).append((r["turn"], r["learn"]))
    assert by == {
        (1, "prompt"): [(0, False), (1, False), (2, False)],
        (1, "chosen"): [(3, True)],
        (1, "rejected"): [(3, True), (4, False)],
        (2, "prompt"): [(0, False)],
        (3, "chosen"): [(None, True)],
        (None, "chosen"): [(0, False)],
        (None, "rejected"): [(0, False)],
    }
    example = chat.preference_examples(segments).where("pair_id = 1").first()
    assert example["prompt"] == "<|user|>\nt0<|end|>\n<|assistant|>\nt1<|end|>\n<|user|>\nt2<|end|>\n"
    (lo, hi), = example["rejected_mask"]
    assert example["rejected"][lo:hi] == "<|assistant|>\nbad<|end|>\n"


def test_no_conversations(spark):
    assert chat.preference_segments(spark.createDataFrame([], TURNS)).count() == 0


def test_hash_limits():
    assert urls.hash_limit(50_000, 50_000) == urls.hash_limit(60_000, 50_000) == (1 << 63) - 1
    for rows in (10**6, 10**11, 10**15):
        share = (urls.hash_limit(50_000, rows) + (1 << 63)) / 2**64
        assert abs(share * rows - 50_000) < 1


def _rule_of(url, rules):
    """Host, path and the longest rule of a URL, step by step."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, _ in rules:
        name, begin = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = (host == name or host.endswith("." + name)) and path.startswith(begin)
        if fits and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_rules_of_all_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = urls.judged_urls(pages, URL_RULES).collect()
    given = {r["page_id"]: r["url"] for r in pages.collect()}
    assert len(rows) == len(given)
    said = dict(URL_RULES)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == _rule_of(given[r["page_id"]], URL_RULES)
        assert r["verdict"] in ("allow", "block") and (r["rule"] is None or r["verdict"] == said[r["rule"]])


def test_repeated_urls_and_ids(spark):
    """A URL on very many rows is one URL for the trees, and all its rows get one verdict."""
    rows = [(1, "http://spam.example.org/es/x?a=1")] * 300
    rows += [(i, f"http://h{i}.org/{i}") for i in range(100)] + [(5, f"http://b{i}.com/de/{i}9") for i in range(100)]
    rows += [(7, "http://free.net/q")] * 20
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.judged_urls(pages, URL_RULES, train_rows=50).collect()
    assert len(out) == len(rows)
    assert {r["verdict"] for r in out if r["host"] == "spam.example.org"} == {"block"}
    assert len({r["verdict"] for r in out if r["host"] == "free.net"}) == 1


# toxicity


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You IDIOT!", " you idiot "),
        ("1d10t and 15 cats", " idiot and 15 cats "),
        ("іdіоt", " idiot "),
        ("ídïöt", " idiot "),
        ("id\u200biot", " idiot "),
        ("5tup1d", " stupid "),
        (None, "  "),
        ("", "  "),
    ],
)
def test_folding(text, want):
    assert toxicity.fold(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("idio7", " idiot "),
        ("worthle$$ thing", " worthless thing "),
        ("!diot!", " idiot "),
        ("c1own, 1oser", " clown loser "),
        ("w0rth1e55", " worthless "),
        ("idiot!! Trash!", " idiot trash "),
        ("level7 and 7up, h4t", " level7 and tup hat "),
        ("1oserville", " loserville "),
        ("x" * 50 + "7", f" {'x' * 50}7 "),
    ],
)
def test_readings_of_known_words(text, want):
    entries = {" idiot ": 1.0, " worthless ": 1.0, " clown ": 1.0, " loser": 1.0, " trash ": 1.0}
    assert toxicity.Lexicon(entries).fold(text) == want


def test_hits_against_a_plain_search():
    rng = np.random.default_rng(12)
    words = ["trash", "can", "idiot", "idiots", "fool", "of", "day", "a", "tra"]
    entries = {" trash ": 2.0, " idio": 1.5, " fool ": 1.0, " tra": 0.5, " a ": 0.1}
    exceptions = frozenset({" trash can ", " a fool of ", " idiots day "})
    lexicon = toxicity.Lexicon(entries, exceptions)
    for _ in range(200):
        folded = toxicity.fold(" ".join(rng.choice(words, int(rng.integers(0, 12)))))
        spans = [(i, i + len(p) - 1) for p in exceptions for i in range(len(folded)) if folded.startswith(p, i)]
        want = {}
        for entry, weight in entries.items():
            for i in range(len(folded)):
                if folded.startswith(entry, i) and not any(lo <= i < hi for lo, hi in spans):
                    want[i] = max(want.get(i, weight), weight)
        assert lexicon.hits(folded) == sorted(want.items())


def test_hits_in_a_long_text_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({" trash ": 3.0}, frozenset({" trash can "}))
    took = []
    for n in (20_000, 80_000):
        folded = toxicity.fold("trash trash can " * n)
        start = time.perf_counter()
        assert len(lexicon.hits(folded)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_entries_of_equal_evidence_come_in_one_order(spark):
    """Ties go by the phrase, so the bound on entries gives the same lexicon for any order of rows."""
    rows = [(i, "alpha beta gamma delta", 1) for i in range(60)] + [(100 + i, "fine words only", 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    found = [toxicity.learn_lexicon(docs.repartition(n), labels, F.lit(True), most_entries=3).entries for n in (1, 5)]
    assert found[0] == found[1] and len(found[0]) == 3


def test_exceptions_and_length():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " idio": 4.0}, frozenset({" trash can "}))
    assert lexicon.hits(toxicity.fold("the trash can")) == []
    assert len(lexicon.hits(toxicity.fold("trash idiots, trash can"))) == 2
    short, long = "you idiot", "you idiot " + "fine words " * 500
    assert lexicon.score(short) > lexicon.score(long)
    assert toxicity.Lexicon({}, prior=0.25).score("x") == 0.25


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)


def test_toxicity_of_awkward_rows(spark):
    docs = h.documents(spark)
    labels = spark.createDataFrame([(7, 0, 1), (8, 0, 0), (None, 1, 1), (5, 1, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = toxicity.scored_documents(docs, given).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored_documents(h.empty(spark), labels).count() == 0
    assert toxicity.clean_documents(docs, labels.limit(0)).columns == docs.columns


# queries and pipeline


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = Scratch(spark, "test").table(stage(spark, docs, FOLDER), name)
        assert after.columns == docs.columns
        before, now = (Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in (docs, after))
        assert set(now) <= set(before)
        if name == "exact_dedup":
            texts = ["".join(h.words(r["text"])) for r in after.collect()]
            assert len(texts) == len(set(texts))
        if name == "near_dedup":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            component = h.near_components(texts, 5)
            assert set(now) == {i for i, c in component.items() if i == c}
        if name == "mixing":
            assert max(now.values()) <= 3
        docs = after
    packed = corpus_pipeline.packing(spark, docs, FOLDER).where("piece = 0")
    assert packed.count() == docs.count()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ("op2_url_boosted_trees", "op4_reshard_min_cost_flow", "op8_spherical_caps")])
def test_queries_give_a_row_per_input_row(spark, name):
    table = {"op2": "pages", "op4": "documents", "op8": "embeddings"}[name[:3]]
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_checks_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
