"""Toxicity by a weighted lexicon, found by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch, crc_of_id

#: Labelled rows that the lexicon and its calibration are fitted on, of each label.
ROWS_PER_LABEL = 10_000
#: Entries kept by weight of evidence, and exceptions by frequency: the default bound of a lexicon's size.
ENTRIES = 5_000
#: Lengths of word beginnings that may be entries besides whole words.
STEMS = range(3, 9)
#: Words added to a text's length when hits are divided by it, so that very short texts are not all or nothing.
LENGTH_PRIOR = 10

# Letters of other scripts that look like Latin ones.
_HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ʟ": "l", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "γ": "y", "ø": "o", "đ": "d", "ł": "l", "ħ": "h",
}
# Digits and signs that stand for letters inside a word.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_INVISIBLE = [0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
_FOLD = (
    {ord(k): v for k, v in _HOMOGLYPHS.items()} | dict.fromkeys(range(0x300, 0x370)) | dict.fromkeys(_INVISIBLE)
)
_SUBSTITUTED = str.maketrans(_DIGITS)
_SUBSTITUTED_L = str.maketrans(_DIGITS | {"1": "l", "!": "l"})
#: Words with letters and substitutes, at the ends too.
_SPELT = re.compile(r"(?<![\w@$!])(?=[0-9@$!]*[a-z])(?=[a-z]*[0-9@$!])[a-z0-9@$!]+(?!\w)")
_PLAIN = re.compile(r"[a-z]+")
_MIXED = re.compile(r"[a-z0-9@$!]*(?:[a-z][0-9@$!]+(?=[a-z])|(?<![a-z0-9@$!])[0-9@$]+(?=[a-z]))[a-z0-9@$!]*")
_OTHER = re.compile(r"[\W_]+")


def fold(text: str | None, known: Callable[[str], bool] | None = None) -> str:
    """Lower-case words between single spaces: accents off, homoglyphs to Latin, digits inside words to letters.

    Whether a digit or sign stands for a letter is open at the ends of a word (``idio7``, but also ``level7``), and a
    ``1`` may be an i or an l. A spelling of which ``known`` accepts a reading is read so, first with i, then with l;
    all others only have substitutes between letters replaced.
    """
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_FOLD)
    if known is not None:

        def read(m: re.Match) -> str:
            # signs at the end are taken for punctuation first
            bare = m[0].rstrip("!")
            if _PLAIN.fullmatch(bare):
                return m[0]
            for word in dict.fromkeys((bare, m[0])):
                for table in (_SUBSTITUTED, _SUBSTITUTED_L):
                    if known(reading := word.translate(table)):
                        return reading + m[0][len(word) :]
            return m[0]

        text = _SPELT.sub(read, text)
    text = _MIXED.sub(lambda m: m[0].translate(_SUBSTITUTED), text)
    return f" {_OTHER.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Entries (`` word `` for whole words, `` stem`` for beginnings) with weights, exception phrases, calibration."""

    entries: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    #: Intercept, and factors of the logs of the summed weight and of the weight per hundred words.
    logistic: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    #: Score where there are no entries.
    prior: float = 0.0
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}}

    def automaton(self):
        if "automaton" not in self._cache:
            import ahocorasick

            found = ahocorasick.Automaton()
            for phrase in self.entries.keys() | self.exceptions:
                found.add_word(phrase, (len(phrase), self.entries.get(phrase, 0.0), phrase in self.exceptions))
            found.make_automaton()
            self._cache["automaton"] = found
        return self._cache["automaton"]

    def fold(self, text: str | None) -> str:
        """``fold`` that knows the entries."""
        return fold(text, self._is_entry)

    def _is_entry(self, word: str) -> bool:
        if f" {word} " in self.entries:
            return True
        return any(f" {word[:k]}" in self.entries for k in self._stem_lengths() if len(word) >= k)

    def _stem_lengths(self) -> list[int]:
        if "stems" not in self._cache:
            self._cache["stems"] = sorted({len(e) - 1 for e in self.entries if not e.endswith(" ")})
        return self._cache["stems"]

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """Where words with an entry begin, with their best weight; words inside an exception phrase do not count."""
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight, exception) in self.automaton().iter(folded):
            begin = end - length + 1
            if exception:
                spared.append((begin, end))
            if weight:
                best[begin] = max(best.get(begin, weight), weight)
        spared.sort()
        out, reach, k = [], -1, 0
        for begin, weight in sorted(best.items()):
            # both lists are in order of their beginnings, so one sweep finds how far the exceptions begun so far reach
            while k < len(spared) and spared[k][0] <= begin:
                reach, k = max(reach, spared[k][1]), k + 1
            if begin >= reach:
                out.append((begin, weight))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        folded = self.fold(text)
        total = sum(w for _, w in self.hits(folded)) if self.entries else 0.0
        words = max(folded.count(" ") - 1, 0)
        return math.log1p(total), math.log1p(100 * total / (words + LENGTH_PRIOR))

    def score(self, text: str | None) -> float:
        if not self.entries:
            return self.prior
        a, b = self.features(text)
        x = self.logistic[0] + self.logistic[1] * a + self.logistic[2] * b
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _candidates(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _counted(found):
    """Documents of either label that contain each phrase; partial sums are handed on when they grow large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(sums[0].keys() | sums[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([s[n] for n in names], pa.int64()) for s in sums)],
                names=["phrase", "clean", "toxic"],
            )
            sums[0].clear()
            sums[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                sums[toxic].update(found(fold(text)))
                if len(sums[0]) + len(sums[1]) > 300_000:
                    yield flush()
        yield flush()

    return run


def _phrases(lexicon: Lexicon):
    """Every hit together with the word before or after it."""

    def run(folded: str) -> set[str]:
        out = set()
        for begin, _ in lexicon.hits(folded):
            end = folded.find(" ", begin + 1)
            after = folded.find(" ", end + 1)
            before = folded.rfind(" ", 0, begin)
            if after > 0:
                out.add(folded[begin : after + 1])
            if before >= 0:
                out.add(folded[before : end + 1])
        return out

    return run


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge @ w
        hessian = (design.T * (weight * p * (1 - p))) @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    trains: Column,
    rows_per_label: int = ROWS_PER_LABEL,
    most_entries: int = ENTRIES,
) -> Lexicon:
    """Fit a lexicon of at most ``most_entries`` entries on labelled documents for whose id ``trains`` holds.

    At most ``rows_per_label`` rows of each label are used, by the hash of their id; that is the bound of the fit, and
    of the one broadcast. Rows of ``labels`` without an id or a label do not count, and an id labelled both ways is
    toxic. Four fifths choose the entries: words and word beginnings that the toxic ones have far more often. Phrases
    of an entry and a neighbouring word that mostly clean ones have become exceptions. The last fifth calibrates.
    Without rows of both labels the lexicon is empty and its score is the share of toxic labels.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    given = labels.where("doc_id is not null and toxic is not null").where(trains)
    given = given.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    given = given.withColumn("order", F.xxhash64("doc_id"))
    totals = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    prior = totals.get(1, 0) / max(sum(totals.values()), 1)
    if len(totals) < 2:
        return Lexicon({}, prior=prior)
    sample = given.where("toxic = 1").orderBy("order").limit(rows_per_label)
    sample = sample.union(given.where("toxic = 0").orderBy("order").limit(rows_per_label))
    chosen = F.broadcast(sample.select(F.col("doc_id").alias("_id"), "toxic", (F.pmod(F.col("order"), F.lit(5)) == 0).alias("later")))
    rows = scratch.table(
        docs.join(chosen, docs["doc_id"] == chosen["_id"]).select("text", chosen["toxic"], "later"), "sample"
    )
    fit = rows.where("not later").select("text", "toxic")
    number = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    n_clean, n_toxic = number.get(0, 0), number.get(1, 0)

    def log_odds(toxic: Column, clean: Column) -> Column:
        return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))

    def evidence(toxic: Column, clean: Column) -> Column:
        """Log-likelihood ratio against one common rate."""
        rate = (toxic + clean) / F.lit(max(n_toxic + n_clean, 1))

        def part(x: Column, n: int) -> Column:
            return F.when(x > 0, 2 * x * F.log(x / (rate * n))).otherwise(0.0)

        return part(toxic, n_toxic) + part(clean, n_clean)

    ddl = "phrase string, clean long, toxic long"
    counted = fit.mapInArrow(_counted(_candidates), ddl).groupBy("phrase")
    counted = counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weighed = counted.withColumn("weight", log_odds(F.col("toxic"), F.col("clean"))).withColumn(
        "evidence", evidence(F.col("toxic"), F.col("clean"))
    )
    best = weighed.where("toxic >= 3 and weight > 1.5 and evidence > 15").orderBy(F.desc("evidence"), "phrase")
    entries = {r["phrase"]: float(r["weight"]) for r in best.limit(most_entries).collect()}
    lexicon = Lexicon(entries, prior=prior)
    if not entries:
        return lexicon
    around = fit.mapInArrow(_counted(_phrases(lexicon)), ddl).groupBy("phrase")
    around = around.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    harmless = around.where((F.col("clean") >= 3) & (log_odds(F.col("toxic"), F.col("clean")) < 0))
    exceptions = frozenset(r["phrase"] for r in harmless.orderBy(F.desc("clean"), "phrase").limit(most_entries).collect())
    lexicon = Lexicon(entries, exceptions, prior=prior)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.float64()),
                    batch.column("toxic"),
                ],
                names=["a", "b", "toxic"],
            )

    later = rows.where("later").select("text", "toxic").mapInArrow(featured, "a double, b double, toxic int").toPandas()
    if later["toxic"].nunique() < 2:
        return lexicon
    y = later["toxic"].to_numpy(float)
    share = {k: totals[k] / max((y == k).sum(), 1) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    logistic = _fit_logistic(later[["a", "b"]].to_numpy(), y, weight * len(y) / weight.sum())
    return Lexicon(entries, exceptions, logistic, prior)


def toxicity_score(text: Column, lexicon: Lexicon) -> Column:
    """Score from 0 to 1 of the whole text; a null text is an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(None if t is None or t != t else t) for t in texts], dtype="float64")

    return score(text.cast("string"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return crc_of_id(doc_id) % folds == 0


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; only rows not held out are learned from.

    Null and empty texts and very long ones get a score like any other; null and repeated doc_ids are scored row by
    row. Clashing names of other columns do no harm, as only doc_id and text are read. Empty tables give empty results.
    """
    lexicon = learn_lexicon(docs.select("doc_id", "text"), labels, ~held_out(F.col("doc_id")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = scored.select("doc_id", "held_out", toxicity_score(F.col("text"), lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not judged toxic, with all their columns."""
    lexicon = learn_lexicon(docs.select("doc_id", "text"), labels, ~held_out(F.col("doc_id")))
    return docs.where(toxicity_score(docs["text"], lexicon) < 0.5)
