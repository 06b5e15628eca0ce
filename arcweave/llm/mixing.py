"""Mixing sources to target weights by capped water-filling.

Every step is DataFrame algebra: no Python runs on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import indexed
from .common import Scratch, n_words

#: The seeded order of a source is cut into 16**3 slices, so running sums never need one task per source.
SLICE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float, scratch: Scratch) -> DataFrame:
    """Targets of the sources.

    ``sizes`` has one row a source: ``source`` (null allowed) and ``source_size``.
    Sources in code-point order, null last, get ``weights`` in turn.  They share
    ``share`` times the sum of all sizes by weight; no target exceeds ``max_epochs``
    times its source's size, and what is cut off goes to the others by weight until
    none is above.  A round is one aggregation: sources whose cap is at most the level
    times their weight are clamped, and the level of the others follows from what these
    leave; it only rises, and ends when no further source is clamped.  Sources are
    numbered from range partitions, so any number of them is dealt with.  Sources of
    size 0 get 0.  Returns source, source_size, weight, target.
    """
    # Binary comparison of UTF-8 is code-point order.
    rows = indexed(sizes.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "__number")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("__number"), F.lit(len(weights))) + 1).cast("int"))
    rows = scratch.keep(rows.select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")), "sources")
    size, caps = rows.agg(F.sum("source_size"), F.sum("cap")).first()
    total, level = min((size or 0) * float(share), caps or 0.0), 0.0
    while True:
        clamped = F.col("cap") <= F.lit(level) * F.col("weight")
        used, free = rows.agg(F.sum(F.when(clamped, F.col("cap"))), F.sum(F.when(~clamped, F.col("weight")))).first()
        after = (total - (used or 0.0)) / free if free else level
        if after <= level:
            break
        level = after
    return rows.select("source", "source_size", "weight", F.when(clamped, F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """How much the mix takes of each document.

    A source whose target is ``e`` times its size repeats every document ``floor(e)``
    whole times; for the fraction, its documents are put in a seeded order and taken
    until the words are used up, the last one in part.  So each source's words come
    to its target rounded, and no document is taken more than ``ceil(max_epochs)``
    times.  Reruns agree: the order depends on the id, the size, the text and the seed
    only.

    Null text: size 0, nothing taken.  A null source is a source of its own.  An
    empty table gives an empty result.  Rows equal in id and text are ordered among
    each other arbitrarily, which changes nothing in what is taken of them.  Other columns are not read, but
    those named in ``carry`` come along.  Returns doc_id, source, size, source_size,
    target, epochs, taken and the carried columns.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("__turn"),
        F.xxhash64(F.col(text_col)).alias("__tie"),
        *[F.col(c).alias(f"__carry_{k}") for k, c in enumerate(carry)],
    ).withColumn("__slice", F.substring("__turn", 1, SLICE_DIGITS))
    scratch = Scratch(docs.sparkSession, "mixing")
    if not carry:
        # Without texts rows are narrow: written once, so that words are counted once.
        rows = scratch.keep(rows, "rows")
    slices = scratch.keep(rows.groupBy("source", "__slice").agg(F.sum("size").alias("__words")), "slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, share, max_epochs, scratch)
    earlier = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16**SLICE_DIGITS rows a source.
    starts = slices.withColumn("__before", F.coalesce(F.sum("__words").over(earlier), F.lit(0)))
    plan = starts.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    plan = plan.select(F.col("source").alias("__s"), F.col("__slice").alias("__l"), "__before", "source_size", "target")
    within = Window.partitionBy("source", "__slice").orderBy("__turn", "doc_id", "size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = out.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__l")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - F.col("__whole") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__before") - F.col("__ahead")))
    return out.withColumn("__whole", epochs).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("epochs"),
        (F.col("__whole") * F.col("size") + part).alias("taken"),
        *[F.col(f"__carry_{k}").alias(c) for k, c in enumerate(carry)],
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row a repetition.

    A document taken in part ends after that many words; ``n_chars``, where it is a
    column, follows.  Documents of which nothing is taken go, those without words too.
    """
    text, names = options.get("text_col", "text"), docs.columns
    taken = mix_sources(docs, carry=[c for c in names], **options)
    # Carried columns may clash with computed ones: they come last, so rename by place.
    base = ["__id", "__source", "__size", "__source_size", "__target", "__epochs", "__taken"]
    rows = taken.toDF(*base, *[f"__c{k}" for k in range(len(names))])
    t = F.col(f"__c{names.index(text)}")
    again = F.when(F.col("__size") > 0, F.ceil(F.col("__taken") / F.col("__size"))).otherwise(0).cast("int")
    rows = rows.filter(F.col("__taken") > 0).withColumn("__turns", F.sequence(F.lit(1), again))
    rows = rows.withColumn("__turn", F.explode("__turns"))
    left = F.col("__taken") - (F.col("__turn") - 1) * F.col("__size")
    cut = _first_words(t, left)
    rows = rows.withColumn("__text", F.when(left >= F.col("__size"), t).otherwise(cut))
    out = []
    for k, c in enumerate(names):
        col = F.col(f"__c{k}")
        if c == text:
            col = F.col("__text")
        elif c == "n_chars":
            col = F.char_length("__text").cast(docs.schema[c].dataType)
        out.append(col.alias(c))
    return rows.select(*out)


def _first_words(text: F.Column, n: F.Column) -> F.Column:
    """The first n words joined by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), " ")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
