"""Small awkward tables, and plain-Python versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "One two THREE",
    "one two three",
    "one\ttwo  three\n",
    "the cat sat on the mat and the dog sat on the cat today",
    "the cat sat on the mat and the dog sat on the cat now",
    "the cat sat on the mat and the dog sat on the cat now",
    LONG,
    LONG + " end",
    "ünïcödé wörds über alles <|endoftext|> 漢字 😀",
]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(edges, nodes) -> dict:
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def near_components(texts: dict, n: int, percent: int = 80) -> dict:
    """Smallest reachable id of each id, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    edges = []
    for i, s in sets.items():
        shared = Counter(j for x in s for j in by[x] if j > i)
        edges += [(i, j) for j, k in shared.items() if 100 * k >= percent * (len(s) + len(sets[j]) - k)]
    return components(edges, list(texts))


DDL = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts=TEXTS, extra: bool = True):
    """The texts as documents, with a repeated row, a null id, null columns, and columns of clashing names."""
    rows = [(i, t, None, None if i % 3 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    if extra:
        rows += [rows[7], (None, "no id at all here", "en", "s1", 3), (None, None, None, None, None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DDL)
    clash = ("band", "node", "size", "fingerprint", "block", "component", "shard", "label", "order", "key", "toxic")
    return df.withColumns({c: F.lit("x") for c in clash}) if extra else df


def empty(spark):
    return spark.createDataFrame([], DDL)
