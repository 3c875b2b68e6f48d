"""URL verdicts: rules where they fit, else gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import SMALL_ROWS, Scratch

#: Labelled URLs that the trees are fitted on, at most.
TRAIN_ROWS = 50_000
TREES = 12
DEPTH = 4

FEATURES = (
    "length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "sign_ratio", "entropy",
    "parameters", "query_length", "suffix_rate", "suffix_share",
)

Rule = tuple[str, str]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null where none does.

    A rule is written host then path. It fits its host and all subdomains where the path starts with its own. Of
    equally long rules the one given first wins. The list is a parameter of the plan, meant for up to some hundreds.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        name, begin = text[:at], text[at:]
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(begin)
        longer = F.coalesce(F.length(rule), F.lit(-1)) < len(text)
        rule, verdict = F.when(fits & longer, text).otherwise(rule), F.when(fits & longer, said).otherwise(verdict)
    return rule, verdict


def _ratio(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def lexical(urls: DataFrame) -> DataFrame:
    """Add the lexical features of ``url`` (with ``host`` and ``path``), all of them column expressions."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    letters = F.filter(F.split(url, ""), lambda c: c != "")
    n = F.greatest(F.size(letters), F.lit(1))
    each = F.transform(F.array_distinct(letters), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    bits = F.aggregate(each, F.lit(0.0), lambda s, k: s - k / n * F.log2(F.greatest(k, F.lit(1)) / n))
    return urls.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
            "host_depth": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": _ratio(url, "[^0-9]"),
            "sign_ratio": _ratio(url, "[0-9A-Za-z]"),
            "entropy": bits,
            "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
            "query_length": F.length(query).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


@dataclass
class UrlModel:
    """Trees and the statistics of the suffixes; without trees every URL gets ``constant``."""

    trees: GBTClassificationModel | None
    #: One row per suffix among the labelled URLs, and whether that is few enough rows to broadcast.
    suffixes: DataFrame | None
    few: bool
    base_rate: float
    constant: str

    def verdicts(self, urls: DataFrame) -> DataFrame:
        """Add ``predicted`` (allow or block) to URLs with lexical features."""
        if self.trees is None:
            return urls.withColumn("predicted", F.lit(self.constant))
        known = _with_suffix(urls, self.suffixes, self.few, self.base_rate)
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        scored = self.trees.transform(vector.transform(known))
        block = vector_to_array("probability")[1] >= 0.5
        return scored.withColumn("predicted", F.when(block, "block").otherwise("allow"))


def hash_limit(wanted: int, rows: int) -> int:
    """The 64-bit value that a share of ``wanted / rows`` of signed hashes does not exceed."""
    return min((1 << 63) - 1, -(1 << 63) + (wanted << 64) // rows)


def _with_suffix(urls: DataFrame, suffixes: DataFrame, few: bool, base_rate: float) -> DataFrame:
    known = urls.join(F.broadcast(suffixes) if few else suffixes, "suffix", "left")
    return known.withColumns(
        {
            "suffix_rate": F.coalesce("suffix_rate", F.lit(base_rate)),
            "suffix_share": F.coalesce("suffix_share", F.lit(0.0)),
        }
    )


def learn_urls(urls: DataFrame, train_rows: int = TRAIN_ROWS) -> UrlModel:
    """Fit trees on distinct URLs with lexical features and ``verdict`` not null.

    Suffix statistics (share of blocked ones, smoothed, and share of all) come from all labelled rows, for every suffix.
    The trees are fitted on about ``train_rows`` distinct URLs at most, those with the smallest hashes; that is the
    documented bound of the sample, at any number of rows.
    """
    scratch = Scratch(urls.sparkSession, "urls")
    labelled = urls.where(F.col("verdict").isNotNull())
    label = (F.col("verdict") == "block").cast("double")
    totals = labelled.agg(F.count("*").alias("n"), F.sum(label).alias("blocked")).first()
    n, blocked = totals["n"], totals["blocked"] or 0.0
    if not 0 < blocked < n:
        return UrlModel(None, None, True, 0.0, "block" if n and blocked == n else "allow")
    rate = blocked / n
    suffixes = labelled.groupBy("suffix").agg(F.sum(label).alias("blocked"), F.count("*").alias("n"))
    suffixes = suffixes.select(
        "suffix",
        ((F.col("blocked") + 10 * rate) / (F.col("n") + 10)).alias("suffix_rate"),
        (F.col("n") / n).alias("suffix_share"),
    )
    suffixes = scratch.table(suffixes, "suffixes")
    few = suffixes.count() <= SMALL_ROWS
    chosen = labelled.where(F.xxhash64("url") <= hash_limit(train_rows, n)).dropDuplicates(["url"])
    numeric = [c for c in FEATURES if not c.startswith("suffix")]
    data = _with_suffix(chosen.select(*numeric, "suffix", label.alias("label")), suffixes, few, rate)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(data)
    data = scratch.table(data.select("features", "label").repartition(8), "train")
    if data.select("label").distinct().count() < 2:
        return UrlModel(None, None, True, 0.0, "block" if rate >= 0.5 else "allow")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=5, featureSubsetStrategy="all").fit(data)
    return UrlModel(trees, suffixes, few, rate, "allow")


def judged_urls(pages: DataFrame, rules: list[Rule], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A verdict for each URL: that of the longest rule that fits, else that of the trees.

    Takes ``page_id, url`` (more columns are ignored) and returns ``page_id, host, path, rule, verdict, predicted``, one
    row per input row. The URLs that rules judge are the labelled ones the trees learn from. A null URL or one
    without ``://`` has an empty host and path and the trees' verdict on its features. Where rules judge nothing, or
    all alike, there is nothing to learn: the verdict is the rules' only one, else allow. Null and repeated page_ids are
    rows like any other; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "judged")
    rule, verdict = rule_columns(rules)
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    urls = lexical(urls.withColumns({"rule": rule, "verdict": verdict}))
    model = learn_urls(urls, train_rows)
    out = model.verdicts(urls)
    return scratch.finish(
        out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "predicted").alias("verdict"), "predicted")
    )
