"""Line dedup over content-defined chunks of lines, with DataFrame functions only.

A rolling hash goes over the lines: window j is a line with words, the blank lines after it and the next line with words, and its hash comes from
the hashes of all these lines. The hashes choose the borders: of two neighbouring windows the one with the smaller hash is a border (so three
lines always hold one, whatever surrounds them), and so is every window with ``long_words`` words or more, counted by spaces.
A chunk is the window at a border; a line of ``long_words`` words or more is also a chunk alone. Borders depend on nothing outside the
chunk and the windows beside it, so they move with their text.

A chunk that occurs again anywhere is a match, and grows: the windows beside it, in every document that has it, are compared too. Between two
borders lies one window at most, so one step reaches the next border or the end of the repeated passage. Chunks and grown windows are grouped by two hashes of all their
lines, blank ones included; a group counts if its bodies are equal bytes. Each keeps its first occurrence (by doc_id, then text hash and place); the lines of later ones go, where they do
not overlap the first. So every repeated passage of three lines with words, of two with ``long_words`` words, or of one such line goes whole, and of every line that goes, an earlier one stays.

Counts are combined map-side, and only chunks whose hash occurs again are compared as text; texts are shuffled once, for that and
for the result. A chunk that fills a third of all
rows is one row per task before the shuffle; the joins that bring decisions back to their rows are ones that adaptive execution
may split.

Defined cases: a null text stays null, an empty text stays empty; a line without words goes only between two lines that go as one chunk;
a short line that is repeated alone stays; repeated rows (one doc_id and text) are one document here, so each keeps the same
lines; null doc_ids come last; a very long text is worked on whole, in time that grows with its lines; an empty table gives an empty result. The input row comes back as ``row``; new columns are new_text,
n_lines, n_removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cuelattice.session import materialize

LONG_WORDS = 50


def _with_windows(df: DataFrame, lines: Column, long_words: int, *keep: str) -> DataFrame:
    """``keep`` and ``w``, all windows in order: first line ``k``, lines ``n``, hash ``h``, ``full`` (many words), and ``alone``: single lines with many words."""

    def facts(line: Column) -> Column:
        # Words need a blank each, so most short lines are told by their length.
        long = F.when(F.length(line) >= 2 * long_words - 1, F.regexp_count(line, F.lit(r"\S+")) >= long_words).otherwise(False)
        spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
        return F.struct(F.xxhash64(line).alias("h"), long.alias("long"), line.rlike(r"\S").alias("words"), spaces.alias("s"))

    told = df.select(*keep, F.transform(lines, facts).alias("f"))
    places = F.transform("f", lambda x, i: F.struct(i.alias("k"), *[x[c].alias(c) for c in ("h", "long", "words", "s")]))
    told = told.select(*keep, F.transform("f", lambda x: x["h"]).alias("hs"), F.filter(places, lambda x: x["words"]).alias("p"))

    def window(x: Column, i: Column) -> Column:
        y = F.get("p", i + 1)
        n = y["k"] - x["k"] + 1
        return F.struct(x["k"].alias("k"), n.alias("n"), F.xxhash64(F.slice("hs", x["k"] + 1, n)).alias("h"), (x["s"] + y["s"] + 2 >= long_words).alias("full"))

    # The last line has no next one.
    windows = F.transform(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), window)
    alone = F.transform(F.filter("p", lambda x: x["long"]), lambda x: F.struct(x["k"].alias("k"), F.lit(1).alias("n"), x["h"].alias("h")))
    return told.select(*keep, windows.alias("w"), alone.alias("alone"))


def _borders(w: str) -> Column:
    """The windows that are no larger than a neighbour, or have many words; ``j`` is the window's number."""
    numbered = F.transform(w, lambda x, j: F.struct(j.alias("j"), x["k"].alias("k"), x["h"].alias("h"), x["full"].alias("full")))

    def chosen(x: Column) -> Column:
        before, after = F.get(w, x["j"] - 1)["h"], F.get(w, x["j"] + 1)["h"]
        return x["full"] | before.isNull() & after.isNull() | F.coalesce(x["h"] <= before, F.lit(False)) | F.coalesce(x["h"] <= after, F.lit(False))

    return F.transform(F.filter(numbered, chosen), lambda x: F.struct(x["j"].alias("j"), x["k"].alias("k"), x["h"].alias("h")))


def _with_chunks(base: DataFrame, long_words: int) -> DataFrame:
    """id, th, and of every chunk its window ``j`` (null for a line alone), first line ``k`` and hash ``h``."""
    told = _with_windows(base, F.split("text", "\n", -1), long_words, "id", "th")
    alone = F.transform("alone", lambda x: F.struct(F.lit(None).cast("int").alias("j"), x["k"].alias("k"), x["h"].alias("h")))
    return told.select("id", "th", F.explode(F.concat(_borders("w"), alone)).alias("c")).select("id", "th", "c.*")


def _joined(base: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """``base`` with the rows of ``other`` for its documents, and its lines. The text names all columns of ``base``, so that
    none is pruned and every such join reads one shuffle of the texts."""
    names = [c for c in base.columns if c not in ("id", "th", "text")]
    other = other.withColumnsRenamed({"id": "oid", "th": "oth"})
    both = base.join(other, F.col("id").eqNullSafe(F.col("oid")) & (F.col("th") == F.col("oth")), how)
    some = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names], F.lit(False))
    return both.withColumn("lines", F.split(F.when(some, F.concat("text", F.lit(""))).otherwise(F.col("text")), "\n", -1))


def _grown(met: DataFrame, long_words: int) -> DataFrame:
    """id, th, k, n, h, digest, body of every matched chunk and of the windows beside it."""
    told = _with_windows(met, F.col("lines"), long_words, "id", "th", "lines", "js", "ks")
    near = F.array_distinct(F.flatten(F.transform("js", lambda j: F.array(j - 1, j, j + 1))))
    spans = F.transform(F.filter(near, lambda j: (j >= 0) & (j < F.size("w"))), lambda j: F.struct(*[F.get("w", j)[c].alias(c) for c in ("k", "n", "h")]))
    alone = F.filter("alone", lambda x: F.array_contains("ks", x["k"]))
    told = told.select("id", "th", "lines", F.concat(spans, alone).alias("cs"))
    # ``lines`` is named twice, so that the split is not moved into the lambda.
    body = F.transform("cs", lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"), c["h"].alias("h"), F.array_join(F.slice("lines", c["k"] + 1, c["n"]), "\n").alias("body")))
    return told.select("id", "th", F.explode(F.when(F.size("lines") > 0, body)).alias("c")).select("id", "th", "c.*", F.xxhash64(F.length("c.body"), "c.body").alias("digest"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", long_words: int = LONG_WORDS) -> DataFrame:
    own = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}
    base = docs.select(docs[key].alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("th"), *[docs[c].alias(x) for c, x in own.items()])
    chunks = _with_chunks(base.select("id", "text", "th"), long_words)
    # A repeated row is one document: its chunks count once.
    place = F.xxhash64("id", F.col("id").isNull(), "th", "k")
    again = chunks.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo != hi").select("h")
    found = materialize(chunks.join(again, "h", "left_semi").select("id", "th", "j", "k"), "lines-found")
    asked = found.groupBy("id", "th").agg(F.collect_set("j").alias("js"), F.collect_set(F.when(F.col("j").isNull(), F.col("k"))).alias("ks"))
    # Read twice from one shuffle of the texts: with bodies for the first occurrences, without them for the matches.
    spans = _grown(_joined(base, asked, "inner"), long_words)
    at = F.struct(F.col("id").isNull().alias("z"), "id", "th", "k")
    firsts = spans.groupBy("h", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min("body").alias("b0"), F.max("body").alias("b1"))
    # Equal least and greatest bodies are equal bytes throughout.
    firsts = firsts.filter("first != last AND b0 = b1").select("h", "digest", "first")
    told = spans.drop("body").join(firsts, ["h", "digest"])
    overlaps = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("k") < F.col("first.k") + F.col("n"))
    drop = told.filter(~overlaps).groupBy("id", "th").agg(F.collect_set(F.struct("k", "n")).alias("ks"))
    gone = F.array_distinct(F.flatten(F.transform("ks", lambda c: F.sequence(c["k"], c["k"] + c["n"] - 1))))
    out = _joined(base, drop, "left").withColumn("gone", gone)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    new_text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    row = F.struct(*[F.col(own.get(c, "text")).alias(c) for c in docs.columns])
    return out.select(row.alias("row"), new_text.alias("new_text"), F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
