"""Mixing sources to target weights along a curriculum (operator 2).

Every source has a weight schedule over training time 0..1, linear between
knots. Its demand for words up to time t is the integral of its share. Documents
lie one after another along their source's demand, in the order of a seeded
hash, over and over until the demand is met; a document's training position is
the time at which demand reaches its middle. Range-sorting by position gives the
training order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, n_words, staged


@dataclass(frozen=True)
class Curriculum:
    """What the mix is made of.

    weights: cycled over sources by code point, null last.
    total: words of the mix as a share of all words.
    cap: most words of a source, as a multiple of its size.
    tilt: at time 0 a source's share is (1 + tilt) times its mean share for
    even ranks and (1 - tilt) times for odd ones, turning linearly into the
    opposite at time 1; so the integral over all time stays the target.
    """

    weights: tuple[float, ...] = (3, 1, 2)
    total: float = 1.5
    cap: float = 2.0
    tilt: float = field(default=0.5)
    seed: str = "mix"
    rows_per_part: int = 2_000


def source_targets(sizes: DataFrame, plan: Curriculum) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``rank``, ``weight`` and ``target``.

    Targets stop at ``cap`` times the size, the excess reshared by weight until
    none is above. That is water filling: in the order of cap / weight the
    sources below the level take their cap and the others level * weight.
    One row per source; the sort is over sources, not documents.
    """
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in plan.weights]), ((F.col("rank") % len(plan.weights)) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_rank) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(plan.cap)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(plan.total)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights_left"))
        # the level at the first source that stays below its cap; all caps if none does
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    )
    return filled.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))).drop("cap", "total", "left", "weights_left", "level")


def position(demand: Column, target: Column, tilt: Column) -> Column:
    """The time at which a source's demand reaches ``demand``.

    The share runs from 1 + tilt to 1 - tilt of its mean, so demand at t is
    target * ((1 + tilt) * t - tilt * t * t); this is the inverse.
    """
    x = F.coalesce(F.try_divide(demand, target), F.lit(0.0))  # a source without words has no demand to meet
    b = F.lit(1.0) + tilt
    # 2x / (b + sqrt(b^2 - 4 tilt x)): the stable root, also at tilt 0
    return F.least(F.lit(1.0), F.lit(2.0) * x / (b + F.sqrt(F.greatest(F.lit(0.0), b * b - F.lit(4.0) * tilt * x))))


def laid_out(docs: DataFrame, plan: Curriculum, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, rank, target, at; ``rank``, ``part``, ``nth`` name the row.

    ``at`` is the number of the source's words before the document, in the order
    of a seeded hash. Each source is cut into parts of about ``rows_per_part``
    rows by the hash, part sums are added up first and each part is summed for
    itself, so a source with most of the rows is many tasks.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tie"))
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(plan.seed), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    # null sources group as one; a flag keeps joins on plain equality
    rows = rows.withColumn("src", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    rows = rows.withColumn("slice", F.conv(F.substring("h", 1, 6), 16, 10).cast("long"))  # 0 .. 2^24-1, long as it is multiplied by the number of parts
    rows = staged(rows, "sized")  # texts are read and counted once
    sizes = rows.groupBy("src", "none").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes, plan).withColumn("parts", F.least(F.lit(1 << 20), F.ceil(F.col("n") / plan.rows_per_part)).cast("int"))
    rows = rows.join(targets.select("src", "none", "source_size", "rank", "target", "parts"), ["src", "none"])
    rows = rows.withColumn("part", F.floor(F.col("slice") * F.col("parts") / F.lit(1 << 24)).cast("int"))
    sums = rows.groupBy("rank", "part").agg(F.sum("size").alias("part_size"))
    starts = sums.select("rank", "part", (F.sum("part_size").over(Window.partitionBy("rank").orderBy("part")) - F.col("part_size")).alias("start"))
    inside = Window.partitionBy("rank", "part").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
        .withColumn("nth", F.row_number().over(inside))
        .join(starts, ["rank", "part"])
        .select("doc_id", "source", "size", "tie", "source_size", "rank", "target", (F.col("start") + F.col("inside")).alias("at"), "part", "nth")
    )


def mix(docs: DataFrame, plan: Curriculum = Curriculum(), **columns) -> DataFrame:
    """One row per document with what the mix takes of it.

    doc_id, source, size, tie (digest of the text), source_size, target, taken
    (words, repeats counted), positions (training times, one for each pass that
    takes something).

    Pass p takes the document's words that lie before the target on the source's
    demand axis, so a document at the very end of a source's demand is cut and
    each source's taken words are its target rounded down. Null texts have size
    0 and are never taken, nor is anything of a source without words; null sources are one source, the last. Rows with the
    same id and text lie next to each other, each taken for itself. An empty
    table gives an empty result.
    """
    return _passes(laid_out(docs, plan, **columns), plan).select("doc_id", "source", "size", "tie", "source_size", "target", "taken", "positions")


def sequence(docs: DataFrame, plan: Curriculum = Curriculum(), **columns) -> DataFrame:
    """The mix in training order: a row for each pass that takes something of a document, range-sorted by position.

    doc_id, source, size, source_size, target, ``position`` (training time), ``words`` (taken by this pass), and
    rank, part, nth, which name the document's row. Documents that nothing is taken of come last, with null
    position and no words. Written down, so that its files are in that order.
    """
    rows = _passes(laid_out(docs, plan, **columns), plan)
    one = F.explode_outer(F.arrays_zip(F.col("positions").alias("t"), F.filter("got", lambda x: x > 0).alias("w")))
    rows = rows.select("rank", "part", "nth", "doc_id", "source", "size", "source_size", "target", one.alias("p"))
    rows = rows.select("rank", "part", "nth", "doc_id", "source", "size", "source_size", "target", F.col("p.t").alias("position"), F.coalesce("p.w", F.lit(0).cast("long")).alias("words"))
    order = [F.col("position").asc_nulls_last(), F.col("rank"), F.col("part"), F.col("nth")]
    return staged(rows.repartitionByRange(*order).sortWithinPartitions(*order), "sequence")


def _passes(rows: DataFrame, plan: Curriculum) -> DataFrame:
    """Documents as ``laid_out`` with got (words by pass), taken, positions (of the passes that take something)."""
    tilt = F.when(F.col("rank") % 2 == 0, F.lit(plan.tilt)).otherwise(F.lit(-plan.tilt))
    goal = F.floor("target")
    passes = F.sequence(F.lit(0), F.ceil(F.lit(plan.cap)).cast("int"))
    got = F.transform(passes, lambda p: F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("at") - p * F.col("source_size"))))
    middle = F.transform(passes, lambda p: position(F.col("at") + p * F.col("source_size") + F.col("size") / 2.0, F.col("target"), tilt))
    return (
        rows.withColumn("got", got)
        .withColumn("taken", F.aggregate("got", F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("positions", F.transform(F.filter(F.arrays_zip(F.col("got").alias("w"), middle.alias("t")), lambda x: x["w"] > 0), lambda x: x["t"]))
    )


def training_order(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass that takes at least half of a document, range-sorted by position."""
    docs, names = aside(docs)
    tie = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    mixed = mix(docs, plan).filter("taken > 0").select("doc_id", "tie", "source", "positions", F.least(F.size("positions"), F.round(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    key = lambda df, t: [F.coalesce(df["doc_id"], F.lit(0)).alias("__id"), df["doc_id"].isNull().alias("__no_id"), t.alias("__tie"), F.coalesce(df["source"], F.lit("")).alias("__src"), df["source"].isNull().alias("__no_src")]
    keys = ["__id", "__no_id", "__tie", "__src", "__no_src"]
    # rows that repeat id, text and source share one entry, so that the join keeps their number
    places = mixed.select(*key(mixed, mixed["tie"]), "positions", "copies").groupBy(*keys).agg(F.max(F.struct("copies", "positions")).alias("__m"))
    taken = docs.select(*docs.columns, *key(docs, tie)).join(places, keys)
    placed = taken.select(*docs.columns, F.explode(F.slice("__m.positions", 1, F.col("__m.copies"))).alias("__at"))
    return placed.repartitionByRange("__at", "doc_id").sortWithinPartitions("__at", "doc_id").select(*docs.columns).withColumnsRenamed(names)
