"""Document fingerprints as threshold-scaled sketches, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Sketches of one fraction merge by union, and the
share of one's hashes found in another estimates containment however unequal the documents are: nothing is bounded by the
smaller or larger text.

At a fraction of a half a text of k different shingles has an empty sketch in one of 2^k cases (3 shingles: 12 %, 7: 1 %), and a likeness estimated from n kept
hashes is off by about 0.5 / sqrt(n).

Defined cases: a null text is an empty text; fewer words than ``width`` make one shingle of the whole sequence; no words make
no shingle. Two empty sketches have likeness 1 if their texts are the same, else 0; repeated rows follow each other in order, each with its own edited text; null ids come first and share
one bin; a very long text is worked on whole, in memory that grows with it; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 5
FRACTION = 0.5
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words, case kept."""
    return F.filter(F.split(text, BLANKS, -1), lambda w: w != "")


def sketch_of(words: Column, width: int = WIDTH, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes below the threshold. ``words`` should be a plain column, for it is read once per word."""
    limit = F.lit(-(1 << 63) + int(fraction * (1 << 64)))
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    one = F.transform(F.array(F.lit(0)), lambda _: F.xxhash64(F.array_join(words, " ")))
    hashes = F.when(n >= width, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both documents together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second has; null if the first sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def resemblance(a: Column, b: Column, same_words: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(same_words.cast("double"))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def id_bins(ids: DataFrame, rows_a_bin: int) -> tuple[int, int]:
    """(least id, width) of equal bins of ids that hold few rows each: the width is divided until the fullest bin is small.

    Only ids are read. A bin of width 1 cannot be divided; it holds the texts of one id.
    """
    low, high, n = ids.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if low is None:
        return 0, 1
    width = max(1, (high - low + 1) * rows_a_bin // max(n, 1))
    while width > 1:
        fullest = ids.groupBy(F.floor((F.col("id") - low) / width)).count().agg(F.max("count")).first()[0]
        if fullest <= 16 * rows_a_bin:
            break
        width = max(1, width // 16)
    return low, width


def edited_pairs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, fraction: float = FRACTION, rows_a_bin: int = 1024) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last quarter is replaced by the head of the next document.

    Next is by ``key`` (nulls first), then by text hash, so repeated rows follow each other; after the last comes the first. Texts meet their next one within bins of
    ids, one shuffle of the texts; the last of a bin meets the first of the following bin by a join on these few rows.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    low, step = id_bins(base.select("id"), rows_a_bin)
    base = base.withColumn("bin", F.coalesce(F.floor((F.col("id") - F.lit(low)) / F.lit(step)), F.lit(-1)).cast("long"))
    order = [F.col("id").asc_nulls_first(), F.col("th")]

    def facts(df: DataFrame) -> DataFrame:
        w = df.withColumn("w", words_of(F.col("t")))
        return w.withColumn("sketch", sketch_of(F.col("w"), width, fraction)).drop("w").withColumn("n", F.length("t"))

    def finished(df: DataFrame, t2: str, s2: str) -> DataFrame:
        cut = F.floor(F.col("n") / 4).cast("int")
        edited = F.concat(F.substring("t", F.lit(1), F.col("n") - cut), F.substring(t2, F.lit(1), cut))
        df = df.withColumn("e", edited).withColumn("ew", words_of(F.col("e")))
        df = df.withColumn("es", sketch_of(F.col("ew"), width, fraction))
        return df.select(
            F.col("id").alias(key), F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"),
            as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("es")).alias("edited_fingerprint"),
            resemblance(F.col("sketch"), F.col("es"), F.col("t") == F.col("e")).alias("near_edited"),
            resemblance(F.col("sketch"), F.col(s2), F.col("t") == F.col(t2)).alias("near_next"),
            containment(F.col("sketch"), F.col("es")).alias("within_edited"),
        )

    # The rows at the two ends of every bin, and who follows whom across bins.
    ends = base.groupBy("bin").agg(F.min(F.struct("id", "th")).alias("lo"), F.max(F.struct("id", "th")).alias("hi"))
    over = Window.orderBy("bin")
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(F.col("hi"), F.coalesce(F.lead("lo").over(over), F.first("lo").over(whole)).alias("next"))
    parted = base.repartition("bin")
    near = Window.partitionBy("bin").orderBy(*order)
    met = facts(parted).withColumn("t2", F.lead("t").over(near)).withColumn("s2", F.lead("sketch").over(near))
    inner = finished(met.filter("t2 IS NOT NULL"), "t2", "s2")
    last = base.join(ends.select(F.col("hi.id").alias("hid"), F.col("hi.th").alias("hth"), F.col("next.id").alias("nid"), F.col("next.th").alias("nth")), F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")))
    last = facts(last.groupBy("id", "th", "nid", "nth", "t").count().select("id", "th", "nid", "nth", "t"))
    heads = base.join(ends.select(F.col("next.id").alias("nid"), F.col("next.th").alias("nth")), F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth")), "left_semi")
    heads = facts(heads.dropDuplicates(["id", "th"]).select("id", "th", "t")).select(F.col("id").alias("fid"), F.col("th").alias("fth"), F.col("t").alias("t2"), F.col("sketch").alias("s2"))
    outer = finished(last.join(heads, F.col("nid").eqNullSafe(F.col("fid")) & (F.col("nth") == F.col("fth"))), "t2", "s2")
    return inner.unionByName(outer)
