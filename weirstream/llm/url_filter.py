"""URL filter: rules, and boosted trees on lexical features (operator 9, native)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import aside, n_salts, staged

#: Folds of labelled URLs; what a URL is fitted on was counted over the others.
FOLDS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` for a host with its subdomains and paths that start alike, written as host/path."""

    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.pattern.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Else both empty."""
    rx = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, rx, 1), UPPER, LOWER), F.regexp_extract(url, rx, 2)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features that the characters of a URL give."""
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda c, rx: F.regexp_count(c, F.lit(rx)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: a - F.when(F.length(c) == 1, share(c) * F.ln(share(c))).otherwise(F.lit(0.0)))
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": count(host, r"\."),
        "depth": count(path, "/"),
        "digit_ratio": count(url, "[0-9]") / n,
        "entropy": entropy,
        "parameters": count(url, "[?&][^=&#]+="),
        "hyphens": count(host, "-"),
        "last_number": F.length(F.regexp_extract(path, r"([0-9]*)[^0-9/]*/?$", 1)).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Ends of the host and the path's first part, whose share of blocked URLs is a feature."""
    return {
        "top": F.substring_index(host, ".", -1),
        "second": F.substring_index(host, ".", -2),
        "first_part": F.regexp_extract(path, "^/([^/]*)", 1),
    }


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS)).cast("int")


def _counted(rows: DataFrame) -> DataFrame:
    """kind, value, share, without, hot of every suffix value of a labelled URL or a hot one, counted over all of ``rows``.

    ``share`` is smoothed, (blocked + 1) / (labelled + 2); ``without`` has the shares
    that leave out one fold of URLs each, for fitting. A hot value has more than a
    thousandth of the rows, so there are under 1,000 of a kind.
    """
    hot_from = max(1000, rows.count() // 1000)
    parts = suffixes(F.col("host"), F.col("path"))
    values = rows.select("__ruled", "__fold", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in parts.items()])).alias("s"))
    blocked, labelled = F.col("__ruled") == "block", F.col("__ruled").isNotNull()
    per_fold = [f(c & (F.col("__fold") == i)).alias(f"{n}{i}") for i in range(FOLDS) for f, n, c in ((F.count_if, "ones", blocked), (F.count_if, "n", labelled))]
    counts = values.groupBy("s.kind", "s.value").agg(F.count_if(blocked).alias("ones"), F.count_if(labelled).alias("n"), F.count(F.lit(1)).alias("rows"), *per_fold)
    share = lambda ones, n: (ones + 1) / (n + 2)
    without = F.array(*[share(F.col("ones") - F.col(f"ones{i}"), F.col("n") - F.col(f"n{i}")) for i in range(FOLDS)])
    found = counts.filter((F.col("n") > 0) | (F.col("rows") > hot_from))
    return staged(found.select("kind", "value", share(F.col("ones"), F.col("n")).alias("share"), without.alias("without"), (F.col("rows") > hot_from).alias("hot")), "suffix-shares")


def _with_shares(rows: DataFrame, counted: DataFrame, small: bool, fitting: bool = False) -> DataFrame:
    """``rows`` with ``__share_<kind>``: the share of its value, 0.5 for one that has none. For ``fitting`` without the row's own fold.

    All shares are broadcast if they are few, else those of hot values only. The
    others are joined by value; there a salt, 0 for values that are not hot, spreads
    the rows of hot ones, which have found their share before.
    """
    salts = n_salts(rows.sparkSession)
    told = lambda c: F.coalesce(F.element_at(c, F.col("__fold") + 1) if fitting else c, F.lit(0.5))
    share = F.col("without" if fitting else "share")
    for kind, value in suffixes(F.col("host"), F.col("path")).items():
        of_kind = counted.filter(F.col("kind") == kind)
        hot = (of_kind if small else of_kind.filter("hot")).select(F.col("value").alias("__v"), share.alias("__hot"))
        rows = rows.withColumn("__value", value)
        rows = rows.join(F.broadcast(hot), F.col("__value") == F.col("__v"), "left").drop("__v")
        if small:
            rows = rows.withColumn(f"__share_{kind}", told(F.col("__hot"))).drop("__hot", "__value")
            continue
        cold = of_kind.filter("NOT hot").select(F.col("value").alias("__v"), F.lit(0).alias("__s"), share.alias("__cold"))
        rows = rows.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise((F.monotonically_increasing_id() % salts + 1).cast("int")))
        rows = rows.join(cold.hint("merge"), (F.col("__value") == F.col("__v")) & (F.col("__salt") == F.col("__s")), "left")
        rows = rows.withColumn(f"__share_{kind}", told(F.coalesce("__hot", "__cold"))).drop("__v", "__s", "__salt", "__hot", "__cold", "__value")
    return rows


def judge(
    pages: DataFrame, rules: list[Rule], url: str = "url", max_train: int = 20_000, rounds: int = 12, max_broadcast: int = 20_000
) -> DataFrame:
    """``pages`` with host, path, rule, score (probability of ``block``) and verdict.

    URLs that a rule decides are the labelled ones. Shares of blocked URLs are
    counted over all of them; only the trees are fitted on at most about
    ``max_train``, taken by a hash of the URL, each with shares that leave out its
    own quarter of the URLs, so that no label reaches its own features.
    Shares are broadcast if there are at most ``max_broadcast`` of them (and 8 MB),
    else joined by value, where a value with many of the rows is spread.

    A null URL or one without ``://`` has empty host and path and is scored like
    the others. Without labelled URLs of both kinds the model is a constant;
    without any, the verdict is ``allow``. Input columns named like the new ones
    are replaced.
    """
    pages, names = aside(pages.drop("host", "path", "rule", "score", "verdict"))
    url = next((now for now, before in names.items() if before == url), url)
    host, path = host_and_path(F.col(url))
    rows = pages.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):  # the longest is asked first
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, F.lit(r.pattern)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("__ruled", verdict)

    text = F.coalesce(F.col(url), F.lit(""))
    counted = _counted(rows.select("host", "path", "__ruled", _fold(text).alias("__fold")))
    n, size = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    small = n <= max_broadcast and size <= 8 << 20

    def features(u: Column) -> dict[str, Column]:
        h, p = F.col("host"), F.col("path")
        return lexical(u, h, p) | {f"share_{k}": F.col(f"__share_{k}") for k in suffixes(h, p)}

    labelled = rows.select(text.alias("u"), _fold(text).alias("__fold"), "host", "path", (F.col("__ruled") == "block").cast("int").alias("block")).filter("block IS NOT NULL")
    sample = _with_shares(boosting.bounded(labelled, F.col("u"), max_train), counted, small, fitting=True)
    known = features(F.col("u"))
    sample = staged(sample.select("block", *[c.alias(k) for k, c in known.items()]), "labelled-urls")
    model = boosting.fit(sample, list(known), "block", rounds)
    scored = _with_shares(rows, counted, small).withColumn("__f", F.struct(*[c.alias(k) for k, c in features(text).items()]))
    score = model.probability(lambda k: F.col("__f")[k])
    return (
        scored.withColumn("score", score)
        .withColumn("verdict", F.coalesce("__ruled", F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))))
        .drop("__f", "__ruled", *[k for k in scored.columns if k.startswith("__share_")])
        .withColumnsRenamed(names)
    )
