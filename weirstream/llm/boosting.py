"""Gradient-boosted trees, fitted by Spark ML and applied as a column expression.

A fitted model is turned into nested CASE expressions, so it can score rows, or
the elements of an array inside a row, without leaving code generation's reach
and without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoostedTrees:
    """trees: (weight, node); a node is a number, or (feature, threshold, node if <=, node if >)."""

    features: tuple[str, ...]
    trees: tuple
    prior: float = 0.0

    def probability(self, feature: Callable[[str], Column]) -> Column:
        """Of class 1; ``feature`` gives the column of a feature's name."""

        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            i, cut, left, right = node
            return F.when(feature(self.features[i]) <= F.lit(cut), of(left)).otherwise(of(right))

        margin = F.lit(self.prior)
        for weight, node in self.trees:
            margin = margin + F.lit(weight) * of(node)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _parsed(text: str):
    """The nodes of a tree, from Spark's description of it."""
    lines = iter([x.strip() for x in text.splitlines()[1:] if x.strip()])

    def node():
        line = next(lines)
        if m := re.match(r"If \(feature (\d+) <= (\S+)\)", line):
            left = node()
            next(lines)  # Else
            return (int(m[1]), float(m[2]), left, node())
        return float(line.removeprefix("Predict:"))

    return node()


def fit(rows: DataFrame, features: list[str], label: str, rounds: int = 12, depth: int = 4, seed: int = 7) -> BoostedTrees:
    """Fit on all of ``rows`` (callers bound them); ``label`` is 0 or 1.

    With rows of one class only, or none, the model is a constant: that class
    with probability 0.98, or 0.5.
    """
    rows = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or ones in (0, n):
        share = 0.5 if not n else 0.98 if ones else 0.02
        return BoostedTrees(tuple(features), (), 0.5 * math.log(share / (1 - share)))
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", "label")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.3, maxBins=32).fit(data)
    return BoostedTrees(tuple(features), tuple((float(w), _parsed(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees, strict=True)))


def threshold(scored: DataFrame, label: str, precision: float, bins: int = 200) -> float:
    """The least probability from which on at least ``precision`` of the rows are of class 1.

    ``scored`` has ``p`` and the label. Where no rows reach that, the result is above 1.
    """
    counts = scored.groupBy(F.floor(F.least(F.col("p") * bins, F.lit(bins - 1))).cast("int").alias("bin")).agg(
        F.sum(F.col(label).cast("long")).alias("ones"), F.count(F.lit(1)).alias("n")
    )
    found = {r["bin"]: (r["ones"], r["n"]) for r in counts.collect()}  # a row per bin
    best, ones, n = 2.0, 0, 0
    for b in range(bins - 1, -1, -1):
        o, k = found.get(b, (0, 0))
        ones, n = ones + o, n + k
        if n and ones < precision * n:
            break
        if k:
            best = b / bins
    return best


def bounded(rows: DataFrame, key: Column, at_most: int) -> DataFrame:
    """About ``at_most`` rows, chosen by a hash of ``key`` so that reruns choose the same."""
    n = rows.count()
    if n <= at_most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) < F.lit(int((1 << 20) * at_most / n)))
