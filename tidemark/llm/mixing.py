"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of the whole mix (capped at a number of repeats) and a
schedule: the rate at which the mix draws from it changes linearly over training
time, against the mean of the mix (so the rates always add up to the whole).  Integrating the rate gives the source's cumulative token demand; inverting
that demand turns the place of a document's words within its source into a
training position between 0 and 1.  Range-sorting by position gives the order.

Prefix sums over a hot source never meet in one task: documents are dealt into
(source, hash bucket) cells, only the cells' sums are accumulated per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import forget, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Change of the rate from the middle to the end of training, by the weight's place.
SLOPES = (-0.5, 0.0, 0.5)
MAX_REPEAT = 3
CELL_ROWS = 512



def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(cells: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets of all sources: shares by weight, capped, the excess reshared.

    The fixed point of resharing is a water level: target = min(cap, level * weight)
    with the targets adding up to all sizes.  Sources (one row each) are ordered by
    cap / weight; the level follows from running sums over that order.
    """

    def pick(values):
        place = F.col("__rank") % len(values) + 1
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), place.cast("int"))

    per = cells.groupBy("__src").agg(F.sum("__cell_size").alias("__source_size"))
    # a source is "s" and its name, no source "n": by code point, null last
    per = per.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("__src") == "n", "__src")) - 1)
    per = per.withColumns({"__weight": pick(weights), "__slope": pick(slopes)})
    per = per.withColumn("__ratio", max_repeat * F.col("__source_size") / F.col("__weight"))
    order = Window.orderBy("__ratio", "__rank")
    done = F.coalesce(F.sum("__source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("__weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("__source_size").over(Window.partitionBy())
    per = per.withColumn("__level", (total - max_repeat * done) / left)
    fits = F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("__level", F.coalesce(F.first(fits, ignorenulls=True).over(everything), F.lit(0.0)))
    target = F.least(float(max_repeat) * F.col("__source_size"), F.col("__level") * F.col("__weight"))
    per = per.withColumn("__target", target)
    # rates change against the mix's mean, so that at any time the shares of all sources add up to one
    mean = F.sum(F.col("__target") * F.col("__slope")).over(Window.partitionBy()) / F.sum("__target").over(Window.partitionBy())
    return per.select("__src", F.round(F.col("__slope") - F.coalesce(mean, F.lit(0.0)), 9).alias("__slope"), "__source_size", "__target")


def curriculum(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """All columns of ``docs`` and what the mix takes of each document.

    Adds ``size`` (words), ``source_size``, ``target`` (of its source), ``taken``
    (words, repeats counted) and ``position`` (training position of its first taken
    word; null where nothing is taken).  A column of ``docs`` with one of these names
    is replaced.  Documents of a source follow the md5 of their id (then id and size),
    so reruns agree.  Full repeats come first; the last one stops inside a document
    when the target is reached.  Null text has size 0 and is never taken; a null
    source is a source of its own, the last; null ids share one place in the order;
    repeated rows are documents of their own.  An empty table gives an empty table.
    """
    own = ("size", "source_size", "target", "taken", "position")
    kept = [c for c in docs.columns if c.lower() not in own]
    digits = max(1, min(8, math.ceil(math.log(max(docs.count() / CELL_ROWS, 1.0001), 16))))
    sized = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__src"),
        word_count(F.col("text")).alias("__size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__hash"),
    ).withColumn("__cell", F.substring("__hash", 1, digits))
    cells = sized.groupBy("__src", "__cell").agg(F.sum("__size").alias("__cell_size"))
    up_to = Window.partitionBy("__src").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("__src", "__cell", F.coalesce(F.sum("__cell_size").over(up_to), F.lit(0)).alias("__start"))
    starts = starts.join(source_targets(cells, weights, slopes, max_repeat), "__src")
    within = Window.partitionBy("__src", "__cell").orderBy("__hash", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("__before", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    out = out.join(starts, ["__src", "__cell"]).withColumn("__before", F.col("__before") + F.col("__start"))
    size, total, target, before = (F.col(f"__{c}") for c in ("size", "source_size", "target", "before"))
    full = F.when(total > 0, F.floor(target / total)).otherwise(F.lit(0)).cast("long")
    rest = F.floor(target - full * total + 0.5).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(size, rest - before))
    taken = F.least(full * size + part, max_repeat * size)
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        size.alias("size"),
        total.alias("source_size"),
        target.cast("double").alias("target"),
        taken.alias("taken"),
        F.when(taken > 0, position_of(before, target, F.col("__slope"))).alias("position"),
        before.alias("__before"),
        F.col("__slope"),
    )


def position_of(done: Column, target: Column, slope: Column) -> Column:
    """Inverse of the cumulative demand: the time at which ``done`` words were drawn.

    The rate 1 + a (2t - 1) integrates to (1 - a) t + a t^2, which is solved for t.
    """
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / target))
    rise = 1 - slope
    return F.when(slope == 0, u).otherwise((F.sqrt(rise * rise + 4 * slope * u) - rise) / (2 * slope))


def _rounds(mixed: DataFrame, partitions: int | None, never: bool) -> DataFrame:
    """The rows of ``training_order`` with all columns of ``mixed``, a result of ``curriculum``.

    With ``never`` documents of which nothing is taken have one row too, without text,
    epoch and position, behind the others of a partition.
    """
    size, position = F.col("size"), F.col("position")
    times = F.ceil(F.col("taken") / size).cast("int")
    epochs = F.when(F.col("taken") > 0, F.sequence(F.lit(0), times - 1))
    out = mixed.withColumn("epoch", F.explode_outer(epochs)) if never else mixed.filter("taken > 0").withColumn("epoch", F.explode(epochs))
    out = out.withColumn("words", F.when(F.col("taken") > 0, F.least(size, F.col("taken") - F.col("epoch") * size)).otherwise(F.lit(0).cast("long")))
    done = F.col("epoch") * F.col("source_size") + F.col("__before")
    out = out.withColumn("position", F.when(F.col("taken") > 0, position_of(done, F.col("target"), F.col("__slope"))))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("taken") > 0, F.when(F.col("words") < size, cut).otherwise(F.col("text"))))
    n = partitions or int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # words are spread evenly over the positions, so equal ranges hold equal shares: no sampling pass
    place = F.when(position.isNotNull(), F.least(F.lit(n - 1), F.floor(position * n).cast("int"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    return out.repartitionById(n, place).sortWithinPartitions(F.asc_nulls_last("position"), "doc_id", "epoch")


def training_order(docs: DataFrame, partitions: int | None = None, **mix) -> DataFrame:
    """The documents of the mix in training order, a row for each time one is taken.

    Columns of ``docs``, ``epoch`` (0, 1, ...), ``words`` (taken this time) and
    ``position``; range-partitioned and sorted by position.  A document that is taken
    in part keeps its first ``words`` words, joined by single spaces.
    """
    ordered = _rounds(curriculum(docs, **mix), partitions, False)
    kept = [c for c in ordered.columns if c in docs.columns and c not in ("epoch", "words", "position")]
    return ordered.select(*[F.col(f"`{c}`") for c in kept], "epoch", "words", "position")


def write_order(docs: DataFrame, partitions: int | None = None, **mix) -> DataFrame:
    """The mix written to the shared folder in training order, texts included, and read back.

    Rows as of ``training_order`` (each file sorted by position, the files one range
    after another), with all columns of ``curriculum``; documents of which nothing is
    taken have a row without text, epoch and position.
    """
    mixed = materialize(curriculum(docs, **mix), "mix")  # so texts are shuffled once at a time
    order = materialize(_rounds(mixed, partitions, True), "order")
    forget(mixed)
    return order


def read_digest(order: DataFrame) -> DataFrame:
    """Per document what a written order holds of it: all words taken, and the position of its first ones."""
    of = ["doc_id", "source", "size", "source_size", "target", "__before"]
    taken = order.filter("epoch is not null").groupBy(*of).agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    never = order.filter("epoch is null").select(*of, F.col("words").alias("taken"), "position")
    return taken.union(never).select("doc_id", "size", "source_size", "target", "taken", "position")
