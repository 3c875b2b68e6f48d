"""Benchmark passages in documents: one Aho-Corasick automaton over the items' word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch

#: Windows (one per item that has it) of one automaton, a few hundred bytes each. A benchmark with more is dealt out
#: by hash to several automata, and the documents pass them one after another.
WINDOWS = 200_000
#: Bytes of a document that are split into words at once.
PIECE = 4 << 20

_BREAKS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
# A-Z become a-z before the breaks are told apart; what lies beyond ASCII belongs to words
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c in _BREAKS else c for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a few million bytes at a time."""
    normal, start = text.translate(_NORMAL) if len(text) <= PIECE else None, 0
    if normal is not None:
        yield normal.split()
        return
    while start < len(text):
        end = min(start + PIECE, len(text))
        part = text[start:end].translate(_NORMAL)
        cut = len(part) if end == len(text) else part.rfind(b" ") + 1
        if not cut:  # one word over the whole piece
            more = _WORD.match(text, start)
            part, cut = text[start : more.end()].translate(_NORMAL), more.end() - start
        yield part[:cut].split()
        start += cut


class Windows:
    """The automaton of some windows, each its words joined by spaces, with the items that have it."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.windows = windows
        self.longest = max((w.count(b" ") + 1 for w, _ in windows), default=0)
        self._built = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": None}

    def automaton(self):
        """Words are its letters: known words have numbers from 1, all others are 0."""
        if self._built is None:
            import ahocorasick

            found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            number: dict[bytes, int] = {}
            lengths = []
            for k, (window, _) in enumerate(self.windows):
                key = tuple(number.setdefault(w, len(number) + 1) for w in window.split(b" "))
                found.add_word(key, k)
                lengths.append(len(key))
            found.make_automaton()
            self._built = found, number, lengths
        return self._built

    def find(self, text: bytes) -> tuple[int, list[list[int]], set[int]]:
        """Number of words; runs ``[first, last]`` of word numbers inside any window; which windows occur."""
        runs: list[list[int]] = []
        seen: set[int] = set()
        if not self.windows:
            return sum(len(p) for p in _pieces(text)), runs, seen
        automaton, number, lengths = self.automaton()
        before: list[int] = []
        n = 0
        for piece in _pieces(text):
            ids = before + [number.get(w, 0) for w in piece]
            base = n - len(before)
            for end, k in automaton.iter(tuple(ids)) if ids else ():
                hi = base + end
                if hi < n:  # in the words carried over, and found with the piece before
                    continue
                seen.add(k)
                lo = hi - lengths[k] + 1
                # ends do not fall, so only the latest runs can touch
                while runs and lo <= runs[-1][1] + 1:
                    last = runs.pop()
                    lo, hi = min(lo, last[0]), max(hi, last[1])
                runs.append([lo, hi])
            n += len(piece)
            before = ids[max(len(ids) - self.longest + 1, 0) :] if self.longest > 1 else []
        return n, runs, seen


def spans(text: bytes, runs: list[list[int]]) -> list[dict]:
    """Where runs of words lie in the original text, in code points, end exclusive."""
    wanted = iter(runs)
    run = next(wanted, None)
    edges: list[int] = []
    for k, word in enumerate(_WORD.finditer(text)):
        if run is None:
            break
        if k == run[0]:
            edges.append(word.start())
        if k == run[1]:
            edges.append(word.end())
            run = next(wanted, None)
    if not edges:
        return []
    # code points before each edge: bytes that do not continue one
    begins = (np.frombuffer(text, np.uint8)[: edges[-1]] & 0xC0) != 0x80
    at = np.append(0, np.cumsum(begins))[edges].tolist()
    return [{"start": a, "end": b} for a, b in zip(at[::2], at[1::2], strict=True)]


def _merged(one: list[list[int]], two: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(one + two):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


_STATE = "doc_id {id}, text binary, n_words long, runs array<array<long>>, items array<string>"
_FOUND = "doc_id {id}, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"


def _scan(windows: Windows, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {"n_words": [], "runs": [], "items": []}
            more: dict[str, list] = {"n_hit": [], "spans": []}
            texts = batch.column("text")
            earlier = batch.column("runs").to_pylist(), batch.column("items").to_pylist()
            for text, runs, items in zip(texts, *earlier, strict=True):
                data = (text.as_py() or b"") if text.is_valid else b""
                n, found, seen = windows.find(data)
                runs = _merged(runs, found) if runs else found
                if seen:
                    items = sorted({*items, *(i for k in seen for i in windows.windows[k][1])})
                columns["n_words"].append(n)
                columns["runs"].append(runs)
                columns["items"].append(items)
                if last:
                    more["n_hit"].append(sum(b - a + 1 for a, b in runs))
                    more["spans"].append(spans(data, runs) if runs else [])
            kinds = {
                "n_words": pa.int64(),
                "runs": pa.list_(pa.list_(pa.int64())),
                "items": pa.list_(pa.string()),
                "n_hit": pa.int64(),
                "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
            }
            out = {"doc_id": batch.column("doc_id")} | ({} if last else {"text": texts}) | columns | (more if last else {})
            names = ["doc_id", "n_words", "n_hit", "spans", "items"] if last else ["doc_id", "text", *columns]
            yield pa.RecordBatch.from_arrays(
                [out[c] if isinstance(out[c], pa.Array) else pa.array(out[c], kinds[c]) for c in names], names=names
            )

    return run


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(text or b"")
                for k in range(max(len(w) - size + 1, min(len(w), 1))):
                    ids.append(item)
                    found.append(b" ".join(w[k : k + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    return run


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Which words of each document lie in a passage of ``window`` consecutive words of a benchmark item.

    Takes ``doc_id, text`` and ``item_id, text`` (more columns are ignored, whatever their names) and returns
    ``doc_id, n_words, n_hit, spans, items``, one row per document. ``spans`` are the hit runs in code points of the
    original text; ``items`` are the ids of items that have an occurring window, sorted as strings. Words are runs of
    letters and digits with A-Z lower-cased; what is not ASCII counts as a letter. An item of fewer words is one
    window, one without words has none. A null text has no words. Repeated rows, ids used twice and null doc_ids are
    judged row by row; items of the same id are one item, and a null id reads as the empty string. Without items
    nothing is hit; without documents the result is empty.

    Windows are found and made distinct in Spark, and the automaton's letters are whole words, so a document is split
    once and scanned once. The driver sends out at most about WINDOWS windows: up to that many the documents take one
    narrow pass without a shuffle; more are dealt to several automata by hash, and the documents with what has
    been found so far are written between the passes. A text is held as bytes, and its words a piece at a time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    given = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")
    )
    found = scratch.table(given.mapInArrow(_item_windows(window), "item string, window binary").distinct(), "windows")
    parts = max(1, -(-found.count() // WINDOWS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    state = docs.select(
        "doc_id",
        F.col("text").cast("string").cast("binary").alias("text"),
        F.lit(None).cast("long").alias("n_words"),
        F.array().cast("array<array<long>>").alias("runs"),
        F.array().cast("array<string>").alias("items"),
    )
    for part in range(parts):
        mine = found.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part) if parts > 1 else found
        rows = mine.groupBy("window").agg(F.collect_list("item").alias("items")).collect()
        windows = Windows([(bytes(r["window"]), list(r["items"])) for r in rows])
        if part < parts - 1:
            state = scratch.table(state.mapInArrow(_scan(windows, False), _STATE.format(id=kind)), f"part{part}")
    return state.mapInArrow(_scan(windows, True), _FOUND.format(id=kind))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
tokens AS (
  SELECT n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
  FROM items, generate_series(1, greatest(len(w) - 9, 1)) t(k) WHERE len(w) > 0 ),
sizes AS (SELECT DISTINCT size FROM windows),
hits AS (
  SELECT n, k, o.size, item_id FROM (
    SELECT n, k, size, array_to_string(w[k:k + size - 1], ' ') AS win
    FROM tokens, sizes, generate_series(1, len(w) - size + 1) t(k)) o
  JOIN windows ON windows.size = o.size AND windows.win = o.win),
hit AS (SELECT n, count(DISTINCT pos) AS n_hit FROM hits, generate_series(k, k + size - 1) t(pos) GROUP BY n),
named AS (SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT n, item_id FROM hits) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM tokens LEFT JOIN hit ON tokens.n = hit.n LEFT JOIN named ON tokens.n = named.n
"""
