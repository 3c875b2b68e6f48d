"""Benchmark passages against a plain search over all windows."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubmeta.llm import decontaminate

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, items, size):
    windows = {}
    for item, text in items:
        w = [x.translate(LOWER) for x in WORD.findall(text or "")]
        for k in range(max(len(w) - size + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        found = list(WORD.finditer(text or ""))
        w = [m.group().translate(LOWER) for m in found]
        hit, names = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    names |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        spans = []
        for k, m in enumerate(found):
            if hit[k]:
                if k and hit[k - 1]:
                    spans[-1][1] = m.end()
                else:
                    spans.append([m.start(), m.end()])
        out.append((doc, len(w), sum(hit), [tuple(s) for s in spans], sorted(names)))
    return out


def _got(df):
    return [(r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in df.collect()]


ITEMS = [(1, "The cat sat on the mat today"), (10, "cat SAT, on the—mat"), (2, "a b"), (3, ""), (4, None), (None, "no id"), (2, "é漢 x")]
TEXTS = [
    None,
    "",
    " .,; ",
    "THE CAT sat... on the mat, today! the cat",
    "été é漢 x, 😀a b😀 a b a b",
    "xa b a bx",
    "No id (no ID)",
    "cat sat on the—mat",
    "cat sat on the mat",
    "w " * 3000 + "the cat sat on the mat " + "w" * 5000 + " a b",
]


@pytest.mark.parametrize("piece", [8, 50, 4 << 20])
@pytest.mark.parametrize("windows", [1, 3, 200_000])
def test_against_a_plain_search(spark, monkeypatch, windows, piece):
    monkeypatch.setattr(decontaminate, "WINDOWS", windows)
    docs = [(i if i != 5 else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    # the piece is read in workers, so texts are cut here by calling the automaton itself
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "items", "n_words", "window")})
    given = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit("x"))
    key = lambda r: (repr(r),)
    assert sorted(_got(decontaminate.benchmark_passages(df, given, 4)), key=key) == sorted(plain(docs, ITEMS, 4), key=key)


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_of_a_text(monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rng = np.random.default_rng(piece)
    windows = decontaminate.Windows([(b"a b c", ["1"]), (b"c", ["2"]), (b"b b b b", ["3"]), (b"a b c a b c a b c a", ["4"])])
    for _ in range(100):
        text = "".join(rng.choice(["a", "b", "c"]) + str(rng.choice([" ", " ", ". ", "", "é "])) for _ in range(60))
        n, runs, seen = windows.find(text.encode())
        want = plain([(0, text)], [(int(i[0]), w.decode()) for w, i in windows.windows], 10)[0]
        spans = [(s["start"], s["end"]) for s in decontaminate.spans(text.encode(), runs)]
        assert (n, sum(b - a + 1 for a, b in runs), spans) == want[1:4]
        assert sorted(i for k in seen for i in windows.windows[k][1]) == want[4]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert _got(decontaminate.benchmark_passages(docs, none)) == [(1, 2, 0, [], [])]
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.benchmark_passages(docs.where("false"), items).count() == 0
