"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
there up to ``?``, ``#`` or the end. A rule names a host and the start of a path; it fits the host and
its subdomains, and the longest rule that fits decides. URLs that no rule fits get the verdict of
boosted trees, which are fitted on labelled URLs: by default those that the rules decide.

The trees see lexical features only. They are fitted on a bounded sample: the ``sample_rows``
labelled URLs with the smallest hashes. Suffix statistics are counted over all labelled URLs and joined to
every URL by its suffix. Every URL is judged.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits,
and is judged by the trees; repeated URLs get equal verdicts; with fewer than two classes to learn
from, URLs without a rule are allowed; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimline.scratch import written

#: Verdict by host and start of path.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

SAMPLE_ROWS = 20_000
TREES, DEPTH, STEP = 20, 4, 0.2

FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens",
    "entropy", "host_entropy", "parameters", "query_length", "has_fragment", "secure", "numeric_path",
    "longest_part", "suffix_share", "suffix_weight",
]


def host(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. The rules are part of the plan: a stated, short list."""
    fitting = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        on_host = (host_col == name) | F.endswith(host_col, F.lit("." + name))
        fitting.append(F.when(on_host & F.startswith(path_col, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fitting, F.lit(None).cast("string"))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits, over ASCII letters, digits and signs."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    counts = [n - F.length(F.translate(text, chr(c), "")) for c in (*range(0x2D, 0x3A), *range(0x61, 0x7B))]
    terms = [F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0) for k in counts]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def features(rows: DataFrame) -> DataFrame:
    """Add the lexical features of ``url``, ``host`` and ``path``, except those of the suffix."""
    url, h, p = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = F.split(p, "/")
    numbers = {
        "length": F.length(url),
        "host_length": F.length(h),
        "path_length": F.length(p),
        "depth": F.length(p) - F.length(F.translate(p, "/", "")),
        "labels": F.length(h) - F.length(F.translate(h, ".", "")),
        "digit_ratio": _digits(url) / F.greatest(F.length(url), F.lit(1)),
        "host_digit_ratio": _digits(h) / F.greatest(F.length(h), F.lit(1)),
        "hyphens": F.length(h) - F.length(F.translate(h, "-", "")),
        "entropy": _entropy(F.lower(url)),
        "host_entropy": _entropy(h),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "has_fragment": F.contains(url, F.lit("#")),
        "secure": F.startswith(F.lower(url), F.lit("https:")),
        "numeric_path": F.exists(parts, lambda x: x.rlike("^[0-9]+$")),
        "longest_part": F.array_max(F.transform(parts, F.length)),
    }
    return rows.withColumns({k: v.cast("double") for k, v in numbers.items()})


def suffix(host_col: Column) -> Column:
    """The last label of the host."""
    return F.substring_index(host_col, ".", -1)


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, share, weight): smoothed share of blocked URLs of each suffix, and the weight of that evidence."""
    counts = labelled.groupBy(suffix(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    return counts.select("suffix", ((F.col("b") + 1) / (F.col("n") + 2)).alias("share"), (F.col("n") / (F.col("n") + 10)).alias("weight"))


def _with_suffix(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Add the statistics of the suffix; 0.5 and no weight for one that no labelled URL has."""
    known = {"suffix_share": F.coalesce("share", F.lit(0.5)), "suffix_weight": F.coalesce("weight", F.lit(0.0))}
    joined = rows.withColumn("suffix", suffix(F.col("host"))).join(counts, "suffix", "left")
    return joined.withColumns(known).drop("suffix", "share", "weight")


def fit(
    labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> tuple[GBTClassificationModel, DataFrame] | None:
    """Trees and suffix statistics from (url, host, path, blocked); None with fewer than two classes."""
    counts = written(suffix_counts(labelled), "url-suffixes")
    labelled = labelled.select("url", "host", "path", "blocked").withColumn("h", F.xxhash64("url"))
    # a threshold on the hash first, so that each task passes on few rows to the final ordering
    share = min(1.0, 2.0 * sample_rows / max(1, labelled.count()))
    near = labelled.filter(F.col("h") <= int(-(2**63) + share * (2**64 - 1025)))
    sample = near.orderBy("h", "url", "blocked").limit(sample_rows).drop("h")
    sample = written(features(sample).coalesce(1), "url-sample")
    if sample.select("blocked").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_with_suffix(sample, counts).coalesce(1))
    trees = GBTClassifier(
        labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=seed, maxBins=32
    )
    return trees.fit(data.select("features", F.col("blocked").cast("double"))), counts


def judge(
    pages: DataFrame,
    rules: dict[str, str] = RULES,
    labelled: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, block_score (null where a rule decides).

    ``labelled``: (url, blocked as 0 or 1) to learn from, instead of the URLs that the rules decide.
    """

    def parsed(df: DataFrame, url: Column, *others: Column) -> DataFrame:
        return df.select(*others, url.alias("url"), host(url).alias("host"), path(url).alias("path"))

    rows = parsed(pages, F.col(f"`{url_col}`"), F.col(f"`{id_col}`").alias("page_id"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        verdicts = F.when(F.col("rule") == rule, verdict).otherwise(verdicts)
    rows = rows.withColumn("decided", verdicts)
    if labelled is None:
        known = rows.filter(F.col("decided").isNotNull())
        known = known.withColumn("blocked", (F.col("decided") == "block").cast("int"))
    else:
        known = parsed(labelled, F.col("url"), F.col("blocked").cast("int").alias("blocked"))
        known = known.filter(F.col("url").isNotNull() & F.col("blocked").isin(0, 1))
    model = fit(known, sample_rows)
    if model is None:
        scored = rows.withColumn("block_score", F.lit(0.0))
    else:
        trees, counts = model
        from pyspark.ml.functions import vector_to_array

        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
        scored = trees.transform(vectors.transform(_with_suffix(features(rows), counts)))
        scored = scored.withColumn("block_score", vector_to_array("probability")[1])
    by_trees = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("decided", by_trees).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("block_score")).alias("block_score"),
    )
