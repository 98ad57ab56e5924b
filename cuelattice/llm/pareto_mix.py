"""Mixing sources to target weights by Pareto order sampling.

A source has a target in words. Its documents' expected copies follow their weights (by default the root of their size, rounded up, so longer
documents are likelier), at most ``most``: copies = least(most, c * weight), with ``c`` such that the expected words are the target; what the
limit takes from heavy documents goes to the others. Every document first gets its certain whole copies (the whole part); the rest
is its inclusion probability p for one copy more. Documents are ranked by random
odds over inclusion odds, U/(1-U) / (p/(1-p)), and the lowest ranks are taken until the words they bring are as near to the
rest of the target as whole documents allow.

``c`` is found on the words per source and weight: documents over the limit are set to it, and ``c`` is taken anew from the others until no more come
over. The border of the ranks is found by counting: words per rank interval are summed with map-side combining, the interval that
holds the border is split again, and only its few rows are sorted. So no task holds a source.

Defined cases: null or blank text has size 0 and takes nothing; a null weight counts as 1, one below 0 as 0, and a document of weight 0 is never taken unless its source's target asks for
every copy; a null source is a source of its own, last in order;
repeated rows share a rank, so they are taken alike, apart from ties that end at the border; rows with one random number (null or repeated keys) are ordered by key and size; a very long text
is a document like any other, and can be what separates a source from its target; an empty table gives an empty
result; the input's columns come back inside ``row``, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelattice.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
INTERVALS = 4096
UNIT_BITS = 13 * 4


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_of(key: str | Column, seed: int) -> Column:
    """A number in (0, 1) that follows from the key alone, so reruns agree."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null")))), 1, UNIT_BITS // 4)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << UNIT_BITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size) to targets: ``share`` of all words by weight, none above ``most`` times its source.

    One row per source goes through one window. With sources in rising order of limit / weight the limited ones come
    first, and each is judged by the level that holds when all before it are at their limits.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("w", w.cast("long")).withColumn("limit", F.col("source_size") * most)
    rise = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    df = df.withColumn("budget", budget).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    df = df.withColumn("limited", level * F.col("w") > F.col("limit"))
    full = F.sum(F.when(F.col("limited"), F.col("limit")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("limited"), F.lit(0)).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("limited"), F.col("limit").cast("double")).otherwise((F.col("budget") - full) * F.col("w") / free)
    return df.select("source", "source_size", target.alias("target"))


def copies_per_weight(levels: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``targets`` with ``c``, expected copies per unit of weight, so that least(most, c * weight) copies of all words are the target.

    ``levels`` (source, weight, words). In every round what would get more than ``most`` copies is set to ``most``, and ``c`` follows from the rest; it only rises, so the
    rounds end with the documents over the limit. A source whose documents are all at the limit has no ``c``.
    """
    plan, full = materialize(targets.withColumn("c", F.lit(0.0)), "mix-targets"), -1
    for turn in range(1 << 20):
        side = plan.withColumnRenamed("source", "s")
        met = levels.join(side, F.col("source").eqNullSafe(F.col("s"))).withColumn("over", F.col("weight") * F.coalesce("c", F.lit(float("inf"))) > most)
        sums = met.groupBy("source").agg(
            F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum(F.when(F.col("over"), F.col("words")).otherwise(0)).alias("full"),
            F.sum(F.when(F.col("over"), F.lit(0.0)).otherwise(F.col("weight") * F.col("words"))).alias("free"),
        )
        plan = materialize(sums.withColumn("c", F.when(F.col("free") > 0, (F.col("target") - most * F.col("full")) / F.col("free"))), f"mix-copies-{turn}")
        last, full = full, plan.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
        if full == last:
            return plan.drop("full", "free")


def mix(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None,
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7,
) -> DataFrame:
    """``row`` (the input row), size, source_size, target, copies (0 to ``most``) and taken (copies * size)."""
    size = n_words(docs[text])
    # Whole numbers, so that their sums do not depend on the order of rows.
    heavy = F.ceil(F.sqrt(size.cast("double"))).cast("double") if weight is None else F.greatest(F.coalesce(docs[weight].cast("double"), F.lit(1.0)), F.lit(0.0))
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), size.alias("size"), docs[source].cast("string").alias("source"),
        unit_of(docs[key], seed).alias("u"), heavy.alias("weight"), docs[key].alias("key"),
    )
    slim = materialize(base.drop("row"), "mix-slim")
    levels = materialize(slim.groupBy("source", "weight").agg(F.sum("size").alias("words")), "mix-levels")
    plan = copies_per_weight(levels, source_targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), most)

    def ranked(df: DataFrame) -> DataFrame:
        side = plan.withColumnRenamed("source", "s")
        df = df.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        wanted = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("c") * F.col("weight"))).otherwise(0.0)
        df = df.withColumn("expected", F.when((F.col("target") >= most * F.col("source_size")) & (F.col("size") > 0), F.lit(float(most))).otherwise(F.coalesce(wanted, F.lit(0.0))))
        df = df.withColumn("sure", F.floor("expected"))
        p = F.col("expected") - F.col("sure")
        odds, chance = F.col("u") / (1 - F.col("u")), p / (1 - p)
        # q/(1+q) of the Pareto rank q = odds/chance: the same order, within [0, 1].
        return df.withColumn("rank", F.when(p > 0, odds / (odds + chance)))

    tie = F.struct(F.col("rank"), F.col("key"), F.col("size"))
    rows = ranked(slim)
    need = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("sure") * F.col("size"))).alias("need"))
    level, width = rows.filter("rank IS NOT NULL AND size > 0"), 1.0
    need = need.withColumn("low", F.lit(0.0))
    for depth in range(2):
        # Words per interval of the ranks still in question; the border is in the first interval that reaches the need.
        width /= INTERVALS
        side = need.withColumnRenamed("source", "s")
        level = level.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        level = level.withColumn("cell", F.least(F.floor((F.col("rank") - F.col("low")) / width), F.lit(INTERVALS - 1)))
        cells = level.groupBy("source", "need", "low", "cell").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
        border = cells.filter(F.col("before") < F.col("need")).groupBy("source").agg(
            F.max_by(F.struct("cell", (F.col("need") - F.col("before")).alias("need"), (F.col("low") + F.col("cell") * width).alias("low")), "cell").alias("b")
        )
        border = materialize(border.select("source", "b.*"), f"mix-border-{depth}")
        side = border.select(F.col("source").alias("s"), F.col("cell").alias("border"))
        level = level.join(side, F.col("source").eqNullSafe(F.col("s"))).filter(F.col("cell") == F.col("border")).drop("s", "border", "cell", "need", "low")
        need = border.drop("cell")
    side = need.select(F.col("source").alias("s"), "need")
    last = level.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    run = Window.partitionBy("source").orderBy(tie).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("size").over(run)).withColumn("before", F.col("upto") - F.col("size"))
    fits = (F.col("upto") <= F.col("need")) | ((F.col("before") < F.col("need")) & (F.col("upto") - F.col("need") < F.col("need") - F.col("before")))
    cut = last.filter(fits).groupBy("source").agg(F.max(tie).alias("cut"))
    # Where no row of the last interval fits, everything before that interval is taken.
    cut = need.select("source", "low").join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    cut = materialize(cut, "mix-cut").withColumnRenamed("source", "s")
    out = ranked(base).join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    taken = F.col("rank").isNotNull() & F.coalesce((F.col("rank") < F.col("low")) | (tie <= F.col("cut")), F.lit(False))
    copies = (F.col("sure") + taken.cast("int")).cast("int")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def copied(mixed: DataFrame) -> DataFrame:
    """The mix itself: every input row as often as it is taken."""
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("n")).select("row.*")
