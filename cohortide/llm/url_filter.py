"""URL filter: rules by host and path first, gradient-boosted trees on lexical features for the rest.

Features: lengths, depth, digit ratio, character entropy, parameter counts, and how often URLs of the
same host suffix (last label, last two labels) were blocked among all labelled ones. A URL that the
trees are fitted on gets the shares of the labelled URLs outside its fold, so its own label is not among
its features. The trees are MLlib's, fitted on at most ``SAMPLE`` labelled URLs; the query takes as
labels the verdicts of the rules. Rules are a short given list and become one expression.

Cases: a null URL, or one without ``://``, has an empty host and path, matches no rule, and is
judged by its features like any other. Rows that repeat get a verdict each. Other columns are not
looked at. Without labelled URLs of both kinds, what no rule covers is allowed.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortide.llm.storage import materialize

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
SAMPLE = 200_000
FOLDS = 5
TREES, DEPTH, SEED = 10, 3, 7
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy",
           "parameters", "hyphens", "longest_label")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host, and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that depend on the URL alone. ``rows`` has url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0),
                          lambda s, c: s + F.when(c != "", -share(c) * F.log2(share(c))).otherwise(0.0))
    labels = F.split("host", r"\.")
    made = {
        "url_length": n, "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.regexp_count("path", F.lit("/")), "labels": F.size(labels),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(n, F.lit(1)),
        "entropy": entropy, "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")),
        "hyphens": F.regexp_count("host", F.lit("-")),
        "longest_label": F.array_max(F.transform(labels, F.length)),
    }
    return rows.withColumns({c: v.cast("double") for c, v in made.items()}).withColumns(
        {"suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2)})


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(13), url), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """Labelled and blocked URLs by fold and the last two labels of the host, which name the last one
    too."""
    return labelled.groupBy(F.substring_index("host", ".", -2).alias("suffix2"),
                            fold_of(F.col("url")).alias("fold")).agg(
        F.count("*").alias("n"), F.sum("label").alias("blocked")).withColumn(
            "suffix1", F.substring_index("suffix2", ".", -1))


def _rate(blocked, n) -> Column:
    """Share of blocked URLs, drawn to a half where there are few."""
    return (blocked + 5) / (n + 10)


def suffix_rates(counts: DataFrame, name: str) -> DataFrame:
    """Share of blocked URLs by suffix."""
    return counts.groupBy(F.col(name).alias(f"of_{name}")).agg(
        _rate(F.sum("blocked"), F.sum("n")).alias(f"rate_{name}"))


def rates_outside(counts: DataFrame, name: str) -> DataFrame:
    """The same for each fold, of the URLs in the other ones."""
    own = counts.groupBy(F.col(name).alias(f"of_{name}"), F.col("fold").alias("of_fold")).agg(
        F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    every = Window.partitionBy(f"of_{name}")
    rest = [F.sum(c).over(every) - F.col(c) for c in ("blocked", "n")]
    return own.select(f"of_{name}", "of_fold", _rate(*rest).alias(f"rate_{name}"))


def with_rates(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    for name, table in rates.items():
        rows = rows.join(table, rows[name] == table[f"of_{name}"], "left").drop(f"of_{name}")
    return rows.na.fill(0.5, [f"rate_{n}" for n in rates])


def fit_trees(labelled: DataFrame, sample: int = SAMPLE):
    """A function that adds ``judged`` (1: block). ``labelled``: url, host, path and label 0 or 1."""
    counts = materialize(suffix_counts(labelled), "suffix-counts")
    n, blocked = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "blocked"))).head()
    if not 0 < blocked < n:
        return lambda rows: rows.withColumn("judged", F.lit(0.0))
    if n > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < sample * (1 << 30) // n)
    known = materialize(lexical(labelled).withColumn("fold", fold_of(F.col("url"))), "labelled-urls")
    for s in ("suffix1", "suffix2"):
        table = rates_outside(counts, s)
        known = known.join(table, (known[s] == table[f"of_{s}"]) & (known["fold"] == table["of_fold"])).drop(
            f"of_{s}", "of_fold")
    rates = {s: materialize(suffix_rates(counts, s), "suffix-rates") for s in ("suffix1", "suffix2")}
    columns = [*LEXICAL, *(f"rate_{s}" for s in rates)]
    trees = GBTClassifier(labelCol="label", featuresCol="features", predictionCol="judged",
                          maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), trees]).fit(
        known.orderBy(F.xxhash64("url", "page_id"), "url")
        .select("label", *columns))
    return lambda rows: model.transform(with_rates(lexical(rows), rates))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, page_id: str = "page_id",
          url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every page. ``labelled``: url and label (1: block)
    to learn from; without it, the pages that a rule covers."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        known = rows.where("ruled is not null").select(
            "page_id", "url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        known = labelled.where("url is not null and label is not null").select(
            F.lit(0).alias("page_id"), "url", F.col("label").cast("double").alias("label"))
        known = known.withColumns({"host": host, "path": path})
    judged = fit_trees(known)(rows)
    by_trees = F.when(F.col("judged") == 1, "block").otherwise("allow")
    return judged.select(F.col("page_id").alias(page_id), "host", "path", "rule",
                         F.coalesce("ruled", by_trees).alias("verdict"))
