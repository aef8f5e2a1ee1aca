"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Every source gets a share of all words by weight, but at most ``max_epochs``
times its own size; what is cut off is shared again by weight.  Within a source
documents follow a fixed pseudo-random order (MD5 of the id); walking through
that order, epoch after epoch, until the target is reached gives every copy of
a document a start on the source's cumulative demand.  The source's weight over
training time is a piecewise linear schedule; its integral, inverted, turns the
start into a training position between 0 and 1.

The order within a source is cut into hash buckets whose number follows the
size of the largest source, so no task sorts more than about ``BUCKET_ROWS``
rows however hot a source is; bucket offsets are sums of sums.

Edge cases: null text counts as empty (size 0: nothing is taken); null sources
form one source, last in order; repeated rows are taken one after the other;
an empty table gives an empty result.  The copy that meets the target is taken
in part, so each source's taken words equal its target, rounded.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, text_of, words_of

WEIGHTS = (5, 2, 1)
#: Weight over training time by weight class: values at equally spaced times, linear in between.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MAX_EPOCHS = 3
BUCKET_ROWS = 50_000


def word_count(text: Column) -> Column:
    return let(words_of(text), F.size).cast("long")


def source_targets(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, rows, rank, weight, target`` from rows with ``source`` and ``size``.

    One row per source.  The water level is found by rounds of distributed sums,
    each of which returns two numbers; a round caps at least one source more.
    """
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", F.row_number().over(order) - 1)
    sources = materialize(
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1))
    )
    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    cap, level, capped = F.col("source_size") * max_epochs, 0.0, -1
    at_cap = F.lit(False)
    while weight:
        level = total / weight
        at_cap = cap < F.col("weight") * F.lit(level)
        n, words, heavy = sources.where(at_cap).agg(
            F.count("*"), F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
        ).first()
        if n == capped:
            break
        capped = n
        rest_weight = sources.agg(F.sum("weight")).first()[0] - heavy
        if not rest_weight:
            break
        all_words = sources.agg(F.sum("source_size")).first()[0]
        total, weight = all_words - words, rest_weight
    return sources.withColumn(
        "target", F.when(at_cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    )


def _never_null(source: Column) -> list[Column]:
    """The source as two columns that plain equality compares."""
    return [F.coalesce(source.cast("string"), F.lit("")).alias("__name"), source.isNull().alias("__unnamed")]


def position_of(share: Column, schedule: tuple[float, ...]) -> Column:
    """Training time at which ``share`` (0 to 1) of a source's demand is met.

    The schedule is scaled so that its integral is 1; on the piece with the
    share, the integral is a quadratic whose root is taken in the stable form.
    """
    step = 1.0 / (len(schedule) - 1)
    area = sum((a + b) / 2 * step for a, b in zip(schedule, schedule[1:]))
    knots = [v / area for v in schedule]
    result, start = F.lit(1.0), 1.0
    pieces = []
    before = 0.0
    for j, (a, b) in enumerate(zip(knots, knots[1:])):
        pieces.append((j * step, before, a, (b - a) / step))
        before += (a + b) / 2 * step
    for start, before, a, slope in pieces:
        over = share - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * over, F.lit(0.0)))
        here = F.lit(start) + F.coalesce(F.try_divide(F.lit(2.0) * over, F.lit(a) + root), F.lit(0.0))
        result = here if before == 0.0 else F.when(share >= F.lit(before), here).otherwise(result)
    return F.least(result, F.lit(1.0))


def plan_mix(
    docs: DataFrame,
    carry: list[str],
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``carry`` columns of every document and the struct ``__mix``.

    Its fields: size, source_size, target, taken (words, over all copies) and
    copies, an array of (epoch, words, position).
    """
    rows = docs.select(
        F.struct(*carry).alias("__row"),
        F.col(source).alias("source"),
        F.col(doc_id).alias("__id"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("__h"),
        word_count(text_of(text)).alias("size"),
    )
    slim = materialize(rows.select("source", "__id", "__h", "size"))
    targets = source_targets(slim, weights, max_epochs)
    largest = targets.agg(F.max("rows")).first()[0] or 1
    buckets = max(1, -(-largest // BUCKET_ROWS))
    bucket = (F.conv(F.substring("__h", 1, 7), 16, 10).cast("long") * buckets / 2**28).cast("long")
    facts = targets.select(
        F.col("source").alias("__s"), "source_size", "target", (F.col("rank") % len(weights)).alias("__kind")
    )
    sums = slim.groupBy("source", bucket.alias("__bucket")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("__bs"), F.col("__bucket"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__base")
    )
    sums = sums.join(facts, F.col("__bs").eqNullSafe(F.col("__s"))).select("*", *_never_null(F.col("__bs"))).drop("__s", "__bs")
    # Rows move once: the window and the join go by the same columns, which are never null.
    group = ["__name", "__unnamed", "__bucket"]
    inside = (
        Window.partitionBy(*group)
        .orderBy("__h", F.col("__id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = rows.select("*", bucket.alias("__bucket"), *_never_null(F.col("source"))).withColumn("__upto", F.sum("size").over(inside))
    placed = placed.join(sums, group)
    goal = F.round("target").cast("long")
    start = F.col("__base") + F.col("__upto") - F.col("size")

    def copy_at(e: int) -> Column:
        at = F.lit(e) * F.col("source_size") + start
        words = F.greatest(F.least(goal - at, F.col("size")), F.lit(0))
        share = F.coalesce(F.try_divide(at.cast("double"), F.col("target")), F.lit(0.0))
        position = position_of(share, schedules[-1])
        for kind, schedule in enumerate(schedules[:-1]):
            position = F.when(F.col("__kind") == kind, position_of(share, schedule)).otherwise(position)
        return F.struct(F.lit(e).alias("epoch"), words.alias("words"), position.alias("position"))

    copies = F.filter(F.array(*(copy_at(e) for e in range(max_epochs))), lambda c: c["words"] > 0)
    return placed.withColumn("__copies", copies).select(
        *(F.col("__row")[c].alias(c) for c in carry),
        F.struct(
            F.col("size"),
            F.col("source_size"),
            F.col("target"),
            F.aggregate("__copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
            F.col("__copies").alias("copies"),
        ).alias("__mix"),
    )


def in_training_order(copies: DataFrame, *ties: str | Column) -> DataFrame:
    """Rows with a copy in ``__copy``, range-sorted by its position, then epoch and ``ties``."""
    copies = copies.withColumn("__at", F.col("__copy.position"))
    return copies.repartitionByRange("__at").sortWithinPartitions("__at", "__copy.epoch", *ties).drop("__at")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position`` of every document, the last two from its copies in the sorted mix.

    ``position`` is that of the document's first copy, null if it has none.
    """
    plan = plan_mix(docs, [doc_id], doc_id=doc_id, **options)
    plan = materialize(plan.select(F.col(doc_id).alias("doc_id"), "__mix", F.monotonically_increasing_id().alias("__row")))
    mix = materialize(in_training_order(plan.select("__row", F.explode("__mix.copies").alias("__copy")), "__row"))
    per = mix.groupBy("__row").agg(F.sum("__copy.words").alias("words"), F.min("__copy.position").alias("first"))
    return plan.join(per, "__row", "left").select(
        "doc_id",
        *(F.col(f"__mix.{c}").alias(c) for c in ("size", "source_size", "target")),
        F.coalesce("words", F.lit(0).cast("long")).alias("taken"),
        F.round("first", 6).alias("position"),
    )


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: one row per copy, range-sorted by training position.

    A copy taken in part has its first words only, joined by single spaces.
    """
    copies = plan_mix(docs, docs.columns, text=text, **options).select(
        *docs.columns, F.col("__mix.size").alias("__size"), F.explode("__mix.copies").alias("__copy")
    )
    cut = let(words_of(text_of(text)), lambda ws: F.array_join(F.slice(ws, F.lit(1), F.col("__copy.words").cast("int")), " "))
    kept = F.when(F.col("__copy.words") < F.col("__size"), cut).otherwise(F.col(text))
    return in_training_order(copies.withColumn(text, kept)).select(*docs.columns)


def in_written_order(mix: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of a written and reread mix, sorted by ``place`` (from 0, in the order of training), with their ``epoch``.

    Spark reads files by size, not in the order they were written; the number in
    a file's name and the row's index in the file bring the order back.  A mix
    that wasn't read from files is taken in the order of its partitions.
    """
    try:
        name = F.col("_metadata.file_name")
        part = F.coalesce(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.lit(0))
        rows = mix.select("*", F.struct(part.alias("part"), name.alias("name")).alias("__file"), F.col("_metadata.row_index").alias("__k"))
    except AnalysisException:
        return in_written_order(materialize(mix), text, doc_id)
    files = rows.groupBy("__file").agg(F.max("__k").alias("last"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("__file").alias("__f"), F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("__base"))
    rows = rows.join(F.broadcast(files), F.col("__file") == F.col("__f"))
    rows = rows.withColumn("place", F.col("__base") + F.col("__k"))
    # copies of a document come in the order of their epochs; ids tell them (the last may be cut), texts where there is no id
    same = [F.col(doc_id), F.when(F.col(doc_id).isNull(), F.xxhash64(text))]
    epoch = F.row_number().over(Window.partitionBy(*same).orderBy("place")) - 1
    later = rows.select("place", epoch.alias("epoch")).where("epoch > 0")
    # The numbers of later copies go by themselves to where their rows lie, so that texts move once.
    later = later.select(*(F.lit(None).cast(mix.schema[c].dataType).alias(c) for c in mix.columns), "place", "epoch", F.lit(False).alias("__own"))
    rows = rows.select(*mix.columns, "place", F.lit(0).alias("epoch"), F.lit(True).alias("__own")).union(later)
    rows = rows.repartitionByRange("place").sortWithinPartitions("place")
    rows = rows.withColumn("epoch", F.max("epoch").over(Window.partitionBy("place"))).where("__own")
    return rows.select(*mix.columns, "place", "epoch")
