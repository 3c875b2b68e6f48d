"""Katz backoff language model: counts, discounts and backoff weights in partitioned tables, scored per token.

Documents are held in blocks of about BLOCK_TOKENS tokens. A block keeps its distinct words once and its texts as
positions in that list. Whatever needs the whole corpus is an exchange: a block sends its distinct keys, cut by hash
range into buckets; a bucket adds up what all blocks sent; and each block gets an answer in the order of its keys. A
key is one entry for a block however often it occurs, so a very frequent word or word pair is no hot key, and both
the blocks and the buckets keep their size as the corpus grows: there are only more of them.

A key that a single block has is its own matter: so is every longer n-gram with that key in it, and the block counts
and weighs them by itself. Most rare n-grams are of this kind and never enter an exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch, chunks, mix, stream, word_hashes

BLOCK_TOKENS = 500_000
#: Keys that a bucket should hold; sets the number of buckets.
BUCKET_KEYS = 1_000_000
#: Counts above this are not discounted.
TOP_COUNT = 5
#: N-grams of order two and up that occur less often are left to the lower order.
LEAST_COUNT = 1
#: Buckets of the block table; Spark takes no more than 100,000.
MOST_BUCKETS = 50_000

_END = np.uint64(0x5851F42D4C957F2D)
_ORDER = stream(16, 11) | np.uint64(1)

_BLOCK = (
    "block long, tokens long, doc_ids binary, null_ids binary, held_out binary, lengths binary, words binary, "
    "learned binary, text binary"
)
_REQUEST = (
    "kind string, bucket int, block long, n long, keys binary, counts binary, extra binary, used binary, tally array<long>"
)
_ANSWER = "kind string, block long, bucket int, answer binary, tally array<long>"


def _pack(a: np.ndarray, kind: type) -> bytes:
    return a.astype(kind).tobytes()


def _planes(a: np.ndarray) -> bytes:
    """The bytes of a number array by significance, packed: small values leave runs of zeros and few different bytes."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    made = 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        nonlocal made
        words, text = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        ids = np.concatenate([h[1] for h in held])
        lengths = np.concatenate([h[3] for h in held])
        out = np.concatenate([h[2] for h in held])
        row = {
            "block": [(part << 31) + made],
            "tokens": [len(text)],
            "doc_ids": [_pack(ids[:, 0], np.int64)],
            "null_ids": [_pack(ids[:, 1], np.bool_)],
            "held_out": [_pack(out, np.bool_)],
            "lengths": [_pack(lengths, np.int64)],
            "words": [_pack_keys(words)],
            "learned": [_planes(np.bincount(text[np.repeat(~out, lengths)], minlength=len(words)).astype(np.uint32))],
            "text": [_planes(text.astype(np.uint32))],
        }
        made += 1
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row)
        )

    tokens = 0
    for whole in batches:
        for batch in chunks(whole):
            hashes, begin = word_hashes(batch.column("text"))
            # one end after each document's words
            hashes = np.insert(hashes, begin[1:], _END)
            ids = batch.column("doc_id")
            pair = np.column_stack(
                [ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)]
            ).astype(np.int64)
            held.append((hashes, pair, batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(begin) + 1))
            tokens += len(hashes)
            if tokens >= BLOCK_TOKENS:
                yield flush()
                held, tokens = [], 0
    if held:
        yield flush()


@dataclass
class Block:
    """One block unpacked: per token its word, the place in its document, and whether its document is learned from."""

    words: np.ndarray
    text: np.ndarray
    lengths: np.ndarray
    held_out: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(
            _unpack_keys(row["words"]),
            _from_planes(row["text"], np.uint32),
            np.frombuffer(row["lengths"], np.int64),
            np.frombuffer(row["held_out"], np.bool_),
        )

    def learned(self) -> np.ndarray:
        return np.repeat(~self.held_out, self.lengths)

    def place(self) -> np.ndarray:
        starts = np.cumsum(self.lengths) - self.lengths
        return np.arange(len(self.text)) - np.repeat(starts, self.lengths)


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run begins in sorted keys; buckets are equal ranges of the hash."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


@dataclass
class Grams:
    """Distinct n-grams of one order in a block: sorted keys, and for every token which of them ends there or -1."""

    keys: np.ndarray
    at: np.ndarray


def _grams(block: Block, keep: np.ndarray, previous: np.ndarray, order: int) -> Grams:
    """N-grams that end at the tokens ``keep``; ``previous`` has each token's hash of the order below."""
    at = np.full(len(block.text), -1, np.int64)
    where = np.flatnonzero(keep)
    if not len(where):
        return Grams(np.zeros(0, np.uint64), at)
    # the history ends one token earlier
    keys, inverse = np.unique(
        mix(previous[where - 1] * _ORDER[order] + block.words[block.text[where]]), return_inverse=True
    )
    at[where] = inverse
    return Grams(keys, at)


def _history(block: Block, grams: Grams) -> np.ndarray:
    """For every n-gram one token at which it ends."""
    found = np.flatnonzero(grams.at >= 0)
    at = np.zeros(len(grams.keys), np.int64)
    at[grams.at[found]] = found
    return at


@dataclass
class Level:
    """What a block knows of one order: the count of each of its n-grams, and which of them it speaks for.

    ``alone`` are those that no other block has; for ``local`` ones that is known from their parts, and nothing is asked.
    ``own`` are the counts in the block.
    """

    grams: Grams
    count: np.ndarray
    owner: np.ndarray
    alone: np.ndarray
    local: np.ndarray
    own: np.ndarray


def _levels(row: dict, order: int) -> tuple[Block, list[Level]]:
    """Rebuild the orders up to ``order`` from the answers a block has; the last may still lack its answer."""
    block = Block.of(row)
    place, learned = block.place(), block.learned()
    levels: list[Level] = []
    hashes = block.words[block.text]
    for n in range(1, order + 1):
        if n == 1:
            grams = Grams(block.words, block.text.astype(np.int64))
        else:
            below = levels[-1]
            frequent = np.append(below.count >= LEAST_COUNT, False)
            good = frequent[below.grams.at]
            keep = good & (place >= n - 1)
            keep[1:] &= good[:-1]
            keep[:1] = False
            grams = _grams(block, keep, hashes, n)
            hashes = np.zeros(len(block.text), np.uint64)
            found = grams.at >= 0
            hashes[found] = grams.keys[grams.at[found]]
        own = np.bincount(grams.at[learned & (grams.at >= 0)], minlength=len(grams.keys)).astype(np.int64)
        local = np.zeros(len(grams.keys), bool)
        if n > 1:
            ends = _history(block, grams)
            local = below.alone[below.grams.at[ends]] | below.alone[below.grams.at[ends - 1]]
        level = Level(grams, np.where(local, own, 0), local & (own > 0), local.copy(), local, own)
        if f"count{n}" in row:
            packed = row[f"count{n}"]
            level.count[~local] = packed >> np.uint64(2)
            level.alone[~local] = packed & np.uint64(2)
            level.owner[~local] = packed & np.uint64(1)
        levels.append(level)
    return block, levels


def _requests(
    kind: str,
    block_id: int,
    keys: np.ndarray,
    counts: np.ndarray | None,
    masses: list[np.ndarray] | None,
    buckets: int,
):
    """One row per bucket: its run of keys with their counts, or with those of the sums that are not zero.

    ``masses`` are the sums of each key and whether the block will back off from it.
    """
    cut = _cut(keys, buckets)
    for b in range(buckets):
        lo, hi = cut[b], cut[b + 1]
        if hi > lo:
            row = {"kind": kind, "bucket": b, "block": block_id, "n": int(hi - lo), "keys": _pack_keys(keys[lo:hi])}
            if masses is None:
                yield row | {"counts": _planes(counts[lo:hi]), "extra": None, "used": None, "tally": None}
            else:
                sums, used = masses[0][lo:hi], masses[1][lo:hi]
                some = np.flatnonzero(sums[:, 0])
                places = np.diff(some, prepend=0).astype(np.uint32)
                packed = {"counts": _planes(places), "extra": _planes(sums[some].ravel())}
                yield row | packed | {"used": _planes(np.packbits(used)), "tally": None}


def _table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    kinds["array<long>"] = pa.list_(pa.int64())
    fields = [f.split() for f in ddl.split(", ")]
    return pa.table({name: pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields})


def _word_requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _unpack_keys(row["words"])
                learned = _from_planes(row["learned"], np.uint32)
                rows = list(_requests("count1", row["block"], words, learned, None, buckets))
                yield from _table(rows, _REQUEST).to_batches()

    return run


def _tally(count: np.ndarray) -> list[int]:
    """The sum of the counts, and how many there are of 1, 2, ... up to TOP_COUNT + 1, and above."""
    often = np.bincount(np.minimum(count, TOP_COUNT + 2).astype(np.int64), minlength=TOP_COUNT + 3)
    return [int(count.sum()), *(int(x) for x in often[1:])]


def _sum_counts(rows: list[dict]) -> list[dict]:
    """Answers for the blocks of a bucket: four times the summed count, plus two if no other block has the key, plus
    one for the first block that learned it."""
    sent = [r["tally"] for r in rows if r["tally"] is not None]
    whole = {"kind": rows[0]["kind"], "block": None, "bucket": rows[0]["bucket"], "answer": None}
    rows = [r for r in rows if r["tally"] is None]
    if not rows:
        return [whole | {"tally": np.sum(sent, axis=0).tolist()}]
    keys = np.concatenate([_unpack_keys(r["keys"]) for r in rows])
    counts = np.concatenate([_from_planes(r["counts"], np.uint32) for r in rows]).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    ordered, n = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    total = np.add.reduceat(n, np.flatnonzero(new))
    group = np.cumsum(new) - 1
    learned = np.flatnonzero(n > 0)
    _, first = np.unique(group[learned], return_index=True)
    owner = np.zeros(len(keys), np.uint64)
    owner[learned[first]] = 1
    packed = np.empty(len(keys), np.uint64)
    alone = (np.bincount(group) == 1).astype(np.uint64)
    packed[order] = (total[group] << np.uint64(2)) | (alone[group] << np.uint64(1)) | owner
    out, at = [], 0
    for r in rows:
        out.append({"answer": _planes(packed[at : at + r["n"]]), "tally": None} | {k: r[k] for k in ("kind", "block", "bucket")})
        at += r["n"]
    out.append(whole | {"tally": np.sum([_tally(total), *sent], axis=0).tolist()})
    return out


def _alpha(mass: np.ndarray) -> np.ndarray:
    """Backoff weight of each history from its mass and the mass one order below, negative where none is left."""
    left = 1 - mass[:, 0]
    return np.where(left > 1e-9, left, -1.0) / np.maximum(1 - mass[:, 1], 1e-12)


def _weights(rows: list[dict]) -> list[dict]:
    """Backoff weights from the masses that all blocks sent, answered to each of them.

    A history whose n-grams use up all of its probability gets a negative answer: see ``Model.weight``. A block that
    never backs off from a history gets only the sign, which packs to almost nothing.
    """
    keys = [_unpack_keys(r["keys"]) for r in rows]
    kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
    mass = np.zeros((len(kinds), 2))
    begin = 0
    for r in rows:
        some = at[begin + np.cumsum(_from_planes(r["counts"], np.uint32), dtype=np.int64)]
        mass[some] += _from_planes(r["extra"], np.float64).reshape(-1, 2)
        begin += r["n"]
    alpha = _alpha(mass)
    out, begin = [], 0
    for r in rows:
        answer = alpha[at[begin : begin + r["n"]]]
        used = np.unpackbits(_from_planes(r["used"], np.uint8), count=r["n"]).astype(bool)
        answer = _planes(np.where(used, answer, np.sign(answer)))
        out.append({"answer": answer, "tally": None} | {k: r[k] for k in ("kind", "block", "bucket")})
        begin += r["n"]
    return out


def _merge(table: pa.Table) -> pa.Table:
    rows = table.sort_by("block").to_pylist()
    return _table(_weights(rows) if rows[0]["kind"].startswith("mass") else _sum_counts(rows), _ANSWER)


def discounts(n: dict[int, int]) -> list[float]:
    """Good-Turing factor for counts 1 to TOP_COUNT from the numbers of n-grams that occur so often.

    Where the formula leaves (0, 1), as it does on small corpora, the count is lowered by one half.
    """
    out = []
    top = (TOP_COUNT + 1) * n.get(TOP_COUNT + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, TOP_COUNT + 1):
        d = (r - 0.5) / r
        if n.get(r) and top < 1:
            found = ((r + 1) * n.get(r + 1, 0) / (n[r] * r) - top) / (1 - top)
            d = found if 0 < found < 1 else d
        out.append(d)
    return out


@dataclass
class Model:
    """The corpus-wide numbers of the model; all others are in the tables of the exchanges."""

    tokens: int
    kinds: int
    factors: dict[int, list[float]]
    unknown: float
    scale: float

    def factor(self, order: int, count: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *self.factors[order], 1.0])
        return table[np.minimum(count, TOP_COUNT + 1)]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """Discounted probability of a word; what the discounts free is the unknown word's."""
        share = self.scale * self.factor(1, count) * count / max(self.tokens, 1)
        return np.where(count > 0, share, self.unknown)

    @staticmethod
    def weight(answer: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weight of each history and the factor of its n-grams.

        A history that has no probability left is given one more occurrence, which goes to its backoff.
        """
        full = answer < 0
        return np.where(full, -answer / (count + 1), answer), np.where(full, count / (count + 1), 1.0)


def _learned_ngrams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int64)[~np.frombuffer(row["held_out"], np.bool_)]
                counts = [int(np.maximum(lengths - n + 1, 0).sum()) for n in range(1, order + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(1, order + 1), pa.int64()), pa.array(counts, pa.int64())], names=["n", "tokens"]
                )

    return run


def _backoffs(block: Block, levels: list[Level], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per token its history of order ``n - 1`` or -1, and whether its n-gram is frequent, so that nothing is backed off."""
    level, below = levels[n - 1], levels[n - 2]
    history = np.full(len(block.text), -1, np.int64)
    history[1:] = below.grams.at[:-1]
    history[block.place() < n - 1] = -1
    at = level.grams.at
    return history, (history >= 0) & (at >= 0) & np.append(level.count >= LEAST_COUNT, False)[at]


def _sums(block: Block, levels: list[Level], model: Model, n: int, lower: np.ndarray) -> np.ndarray:
    """Per history of order ``n - 1`` the discounted mass of its n-grams this block speaks for, and their mass one
    order below; ``lower`` are the tokens' probabilities there."""
    level, below = levels[n - 1], levels[n - 2]
    mine = np.flatnonzero(level.owner & (level.count >= LEAST_COUNT))
    ends = _history(block, level.grams)[mine]
    history = below.grams.at[ends - 1]
    c = level.count[mine]
    high = model.factor(n, c) * c / below.count[history]
    return np.column_stack([np.bincount(history, x, minlength=len(below.count)) for x in (high, lower[ends])])


def _probabilities(block: Block, levels: list[Level], model: Model, row: dict) -> np.ndarray:
    """Per token its probability under the highest of the levels, by recursion from order one up."""
    prob = model.unigram(levels[0].count)[levels[0].grams.at]
    for n in range(2, len(levels) + 1):
        level, below = levels[n - 1], levels[n - 2]
        history, seen = _backoffs(block, levels, n)
        known = history >= 0
        # only a history that is frequent itself can have frequent n-grams; of the others nothing was asked
        answer = np.ones(len(below.count))
        frequent = below.count >= LEAST_COUNT
        answer[frequent & ~below.alone] = row.get(f"mass{n}", np.zeros(0))
        mine = frequent & below.alone
        answer[mine] = _alpha(_sums(block, levels, model, n, prob)[mine])
        weight, factor = model.weight(answer, below.count)
        prob[known] *= weight[history[known]]
        c = level.count[level.grams.at[seen]]
        h = history[seen]
        prob[seen] = factor[h] * model.factor(n, c) * c / below.count[h]
    return prob


def _masses(row: dict, order: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per frequent history of ``order`` that other blocks have too: its ``_sums``, and whether any token of the block
    backs off from it."""
    block, levels = _levels(row, order)
    below = levels[-2]
    sums = _sums(block, levels, model, order, _probabilities(block, levels[:-1], model, row))
    before, seen = _backoffs(block, levels, order)
    used = np.zeros(len(below.count), bool)
    used[before[(before >= 0) & ~seen]] = True
    asked = (below.count >= LEAST_COUNT) & ~below.alone
    return below.grams.keys[asked], sums[asked], used[asked]


def _known(left: pa.Table, right: pa.Table) -> dict:
    """A block's row with its answers unpacked, each in the order of the block's keys."""
    row = left.to_pylist()[0]
    for r in sorted(right.to_pylist(), key=lambda r: r["bucket"]):
        kind = np.float64 if r["kind"].startswith("mass") else np.uint64
        row.setdefault(r["kind"], []).append(_from_planes(r["answer"], kind))
    return {k: np.concatenate(v) if isinstance(v, list) else v for k, v in row.items()}


def _ask(count: int | None, mass: int | None, model: Model, buckets: int):
    """The next requests of a block: counts of one order, backoff masses of another."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if left.num_rows:
            row = _known(left, right)
            if count:
                level = _levels(row, count)[1][-1]
                kind, ask = f"count{count}", ~level.local
                counts = level.own[ask].astype(np.uint32)
                rows += _requests(kind, row["block"], level.grams.keys[ask], counts, None, buckets)
                # what the block counts by itself
                none = dict.fromkeys(("keys", "counts", "extra", "used"))
                at = {"kind": kind, "bucket": row["block"] % buckets, "block": row["block"], "n": 0}
                rows.append(at | none | {"tally": _tally(level.own[level.local])})
            if mass:
                keys, *masses = _masses(row, mass, model)
                rows += _requests(f"mass{mass}", row["block"], keys, None, masses, buckets)
        return _table(rows, _REQUEST)

    return run


_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _score(order: int, model: Model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _SCORES.split(", ")]
        if not left.num_rows:
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        row = _known(left, right)
        block, levels = _levels(row, order)
        prob = _probabilities(block, levels, model, row)
        count = levels[0].count[levels[0].grams.at]
        base = np.log10((count + 1) / (model.tokens + model.kinds + 1))
        starts = np.cumsum(block.lengths) - block.lengths
        ids = np.frombuffer(row["doc_ids"], np.int64)
        return pa.table(
            [
                pa.array(ids, mask=np.frombuffer(row["null_ids"], np.bool_)),
                pa.array(block.held_out),
                pa.array(block.lengths),
                pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                pa.array(np.full(len(ids), model.tokens, np.int64)),
                pa.array(np.add.reduceat(base, starts)),
                pa.array(np.add.reduceat(np.log10(prob), starts)),
            ],
            names=names,
        )

    return run


def katz_scores(docs: DataFrame, held_out: Column, order: int = 3) -> DataFrame:
    """Score every document with a model learned from the rows where ``held_out`` is false.

    Takes ``doc_id long, text`` (more columns are only read by ``held_out``) and returns ``doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score``, one row per input row, scores in log10. Tokens are the words in lower
    case (A-Z) and one end per document, so null and empty texts have one token. A null ``held_out`` counts as true.
    Null and repeated doc_ids are scored like any row. With nothing to learn from, every token is the unknown word,
    at probability one. An empty table gives an empty result.

    Order one is Good-Turing discounted, and what that frees belongs to the unknown word. An n-gram of a higher order
    is used from LEAST_COUNT occurrences on (one: all of them), discounted for counts up to TOP_COUNT. Backoff weights make each history's
    probabilities add up to one exactly. An n-gram can only be that frequent if its parts are, so only those whose
    parts were found to be are counted at all; of those of which one block alone has a part, the block counts itself.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    # kept in hash buckets by block, so that the blocks stay where they are and only requests and answers move
    places = min(max(1, text.rdd.getNumPartitions()), MOST_BUCKETS)
    base = scratch.bucketed(text.mapInArrow(_blocks, _BLOCK), "blocks", "block", places)
    tokens = base.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(1, math.ceil(tokens / BUCKET_KEYS))
    possible = {n: 0 for n in range(1, order + 1)}
    lengths = base.select("lengths", "held_out").mapInArrow(_learned_ngrams(order), "n long, tokens long")
    possible |= {r[0]: r[1] for r in lengths.groupBy("n").agg(F.sum("tokens")).collect()}

    known: list[DataFrame] = []

    def answered(requests: DataFrame) -> dict[str, list[int]]:
        """Store the answers to all requests; what they say of the whole corpus, by kind."""
        scratch.release()
        answers = scratch.table(requests.groupBy("kind", "bucket").applyInArrow(_merge, _ANSWER), "answers")
        known.append(answers.where("block is not null").select("kind", "block", "bucket", "answer"))
        each = answers.where("block is null").select("kind", F.posexplode("tally").alias("r", "n"))
        totals: dict[str, list[int]] = {}
        for r in each.groupBy("kind", "r").agg(F.sum("n").alias("n")).orderBy("kind", "r").collect():
            totals.setdefault(r["kind"], []).append(r["n"])
        scratch.release()
        return totals

    def with_answers(run: Callable, ddl: str) -> DataFrame:
        answers = reduce(DataFrame.union, known)
        return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ddl)

    words = base.select("block", "words", "learned").mapInArrow(_word_requests(buckets), _REQUEST)
    total, *often = answered(words).get("count1", [0])
    found = dict(enumerate(often, 1))
    factors = {1: discounts(found)}
    freed = sum(k * r * (1 - factors[1][r - 1]) for r, k in found.items() if r <= TOP_COUNT)
    # no count low enough to be discounted: one occurrence more, which is the unknown word's
    scale, unknown = (1.0, freed / total) if freed else (total / (total + 1), 1 / (total + 1))
    model = Model(total, sum(often), factors, unknown, scale)
    for n in range(2, order + 2):
        # the counts of order n and the weights of order n - 1 need nothing of each other
        ask = _ask(n if n <= order else None, n - 1 if n > 2 else None, model, buckets)
        tally = answered(with_answers(ask, _REQUEST))
        if n <= order:
            total, *often = tally.get(f"count{n}", [0])
            found = dict(enumerate(often, 1))
            # an n-gram that was not counted has a part that is not frequent, so it occurs once; LEAST_COUNT 1 leaves none
            found[1] = found.get(1, 0) + possible[n] - total
            model.factors[n] = discounts(found)
    return scratch.finish(with_answers(_score(order, model), _SCORES))
