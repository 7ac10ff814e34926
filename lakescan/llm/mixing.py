"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets share all words by weight; none is above ``most`` times its source's words, and what that leaves is shared
again by weight (a water level found in one window over sources). The whole part of a source's target over its size is
the number of certain copies of each of its documents; the rest of the target is ``extra`` words, less than the source.

They are sampled with unequal probabilities, proportionate to the root of the size as far as that goes: twice as large for
each class of sizes four times longer, at most 1, and such that the expected number of words is ``extra`` (a water level
again, over a source's classes). So what is decided last are short documents, and the target is met closely. Documents
at 1 are certain. The others are ranked by random odds over inclusion odds, and the sample is the first of them in that
order, of a fixed size in words: ``extra`` less what is certain. Going down the order a document that no longer fits is
passed over; it ends when no more than ``near`` of the target is free. If the order ends before, one more is taken: the
one of the nearest size (the first in the order of equal ones), if it brings the source nearer.

No source is sorted in one task: the place where a document first fails to fit is found by a histogram of the rank, and
only the documents of its bin are sorted. Places are a few ranges a source, applied to all documents at once.

Random numbers come from a hash of the document's id, text size and its place among equal ones: reruns agree.
Null and empty texts have size 0: they get the certain copies, none counts. Null sources are one source, ordered last.
Repeated rows are units of their own. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, forget, written

#: Bins of the rank; a bin is what is sorted at once.
BINS = 1 << 16
#: A source is no farther from its target than this part of it, if its documents allow.
NEAR = 0.005
#: So many rows, one a source (of some 100 bytes), are sent to all tasks; more are joined by salted keys.
MOST_BROADCAST, SALTS = 100_000, 32


def words(text: str | Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: float = 3.0, cycle: int = 3) -> DataFrame:
    """source, source_size, target of (source, source_size), one row per source.

    Weights 1 to ``cycle``, repeating, by code point, null last. One window over the sources, not over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("cap_level", F.col("source").isNull(), "source")
    above = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("long")).withColumn(
        "cap_level", most * F.col("source_size") / F.col("weight")
    )
    # The level if the sources before are capped: it rises up to the last source that has to be, and then falls.
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(above), F.lit(0))) / F.sum("weight").over(rest)
    found = weighed.withColumn("level", level).withColumn("final", F.max("level").over(everything))
    target = F.least(most * F.col("source_size"), F.col("final") * F.col("weight"))
    return found.select("source", "source_size", target.cast("double").alias("target"))


def uniform(seed: str, *columns: str) -> Column:
    """A number in (0, 1) from 48 bits of MD5."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def size_class(size: Column) -> Column:
    """0 for 1 to 3 words, and one more for each four times as many."""
    return F.floor((F.length(F.bin(size)) - 1) / 2).cast("int")


def _probabilities(units: DataFrame, goal: DataFrame) -> DataFrame:
    """source, chances (inclusion probability by size class), sampled (words of the target that are left to sampling)."""
    strata = units.where("size > 0").groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum(F.col("size") * F.col("equal")).alias("words"))
    strata = _joined(strata, goal.select("source", "extra"), True).withColumn("weight", F.pow(F.lit(2.0), F.col("class")))
    own = Window.partitionBy("source")
    above = own.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    rest = own.orderBy(F.desc("class")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # As for targets: the level if the classes before are certain.
    level = (F.col("extra") - F.coalesce(F.sum("words").over(above), F.lit(0))) / F.sum(F.col("weight") * F.col("words")).over(rest)
    leveled = strata.withColumn("level", level).withColumn("chance", F.least(F.lit(1.0), F.max("level").over(own) * F.col("weight")))
    sure = F.sum(F.when(F.col("chance") >= 1, F.col("words")).otherwise(0))
    return leveled.groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("class", "chance"))).alias("chances"), F.floor(F.first("extra") - sure).cast("long").alias("sampled")
    )


def mix(docs: DataFrame, most: float = 3.0, cycle: int = 3, seed: str = "mix", near: float = NEAR) -> DataFrame:
    """doc_id, source, size, source_size, target, copy_of (place among equal rows), copies, taken, of (doc_id, text, source)."""
    rows = docs.select(F.col("doc_id"), F.col("source"), words("text").alias("size"))
    units = written(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("equal")), "mix-units")
    goal = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size")), most, cycle)
    goal = goal.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = written(goal.withColumn("extra", F.col("target") - F.col("certain") * F.col("source_size")), "mix-targets")
    few = goal.count() <= MOST_BROADCAST
    sources, goal = goal, written(_joined(goal, _probabilities(units, goal), False), "mix-goals")

    each = units.select("source", "doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("equal").cast("int"))).alias("copy_of"))
    each = _joined(each, goal.select("source", "source_size", "target", "certain", "chances"), few)
    chance = F.when(F.col("size") > 0, F.element_at("chances", size_class(F.col("size"))))
    each = each.withColumn("chance", F.coalesce(chance, F.lit(0.0))).drop("chances")
    u = uniform(seed, "doc_id", "size", "copy_of")
    among = (F.col("chance") > 0) & (F.col("chance") < 1)
    each = each.withColumn("rank", F.when(among, (u / (1 - u)) * ((1 - F.col("chance")) / F.col("chance"))))
    each = written(each.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int")), "mix-ranked")
    forget(units, sources)

    ranges = _sampled(each, goal, few, near)
    taken = _is_in(F.col("ranges")) | F.coalesce(F.struct(*PLACE) == F.col("one"), F.lit(False))
    copies = F.col("certain") + (F.col("chance") >= 1).cast("long") + taken.cast("long")
    found = _joined(each, ranges, few).withColumn("copies", copies)
    return found.select("doc_id", "source", "size", "source_size", "target", "copy_of", "copies", (F.col("copies") * F.col("size")).alias("taken"))


PLACE = ("rank", "doc_id", "size", "copy_of")


def _is_in(ranges: Column) -> Column:
    """Whether a document is in one of the ranges of places (after, upto, whether upto is in it, the largest size in it)."""
    place = F.struct(*PLACE)

    def holds(r: Column) -> Column:
        behind = r["after"].isNull() | (place > r["after"])
        before = r["upto"].isNull() | (place < r["upto"]) | (r["last_in"] & (place == r["upto"]))
        return behind & before & (F.col("size") <= r["room"])

    return F.col("rank").isNotNull() & F.coalesce(F.exists(ranges, holds), F.lit(False))


def _sampled(each: DataFrame, goal: DataFrame, few: bool, near: float) -> DataFrame:
    """source, ranges, one: which places of the order are taken. Each round goes on to the next document that does not fit."""
    each = each.where("rank IS NOT NULL").select("source", "bin", *PLACE)
    place = F.struct(*PLACE).alias("place")
    start = each.limit(0).select(place).schema[0].dataType.simpleString()
    free = F.col("target") * near  # what may stay free
    none = F.expr(f"cast(array() AS array<struct<after:{start},upto:{start},last_in:boolean,room:bigint>>)")
    state = goal.select("source", "target", F.coalesce("sampled", F.lit(0)).alias("room"), F.expr(f"cast(NULL AS {start})").alias("after"), none.alias("ranges"))
    state = written(state.withColumn("open", F.col("room") > free), "mix-state")
    while not state.where("open").isEmpty():
        now = state.where("open").select("source", "room", "after", (F.col("room") - free).alias("need"))
        there = _joined(each, now, few).where((F.col("size") <= F.col("room")) & (F.col("after").isNull() | (F.struct(*PLACE) > F.col("after"))))
        sums = there.groupBy("source", "bin", "need").agg(F.sum("size").alias("in_bin"))
        upto = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("sum", upto)
        # Of the first bin with which what is needed is reached; without one, all is taken.
        bins = sums.groupBy("source").agg(F.min(F.when(F.col("sum") >= F.col("need"), F.struct("bin", (F.col("sum") - F.col("in_bin")).alias("before")))).alias("cut"), F.max("sum").alias("all"))
        bins = written(bins, "mix-bins")
        cut = bins.where("cut IS NOT NULL").select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"))
        in_order = Window.partitionBy("source").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
        sorted_ = _joined(there, cut, few).where("bin = cut_bin").withColumn("sum", F.col("before") + F.sum("size").over(in_order))
        first = sorted_.where(F.col("sum") >= F.col("need")).groupBy("source").agg(F.min(F.struct(place, "sum")).alias("first"))
        step = _joined(_joined(state, bins.select("source", "all"), few), first, few)
        at, fits = F.col("first.place"), F.col("first.sum") <= F.col("room")
        took = F.when(F.col("first").isNull(), F.coalesce("all", F.lit(0))).when(fits, F.col("first.sum")).otherwise(F.col("first.sum") - F.col("first.place.size"))
        added = F.struct("after", at.alias("upto"), F.coalesce(fits, F.lit(False)).alias("last_in"), "room")
        on = F.col("open")
        before, state = state, written(
            step.select(
                "source", "target",
                F.when(on, F.col("room") - took).otherwise(F.col("room")).alias("room"),
                F.when(on & ~fits, at).otherwise(F.col("after")).alias("after"),
                F.when(on, F.concat("ranges", F.array(added))).otherwise(F.col("ranges")).alias("ranges"),
                (on & F.coalesce(~fits, F.lit(False))).alias("open"),
            ),
            "mix-state",
        )
        forget(before, bins)
    short = state.where(F.col("room") > free)
    if short.isEmpty():
        return state.select("source", "ranges", F.expr(f"cast(NULL AS {start})").alias("one"))
    left = _joined(each, short.select("source", F.col("room").alias("short"), "ranges"), few).where(~_is_in(F.col("ranges")) & (F.col("size") < 2 * F.col("short")))
    more = left.groupBy("source").agg(F.min_by(place, F.struct(F.abs(F.col("size") - F.col("short")), *PLACE)).alias("one"))
    return written(_joined(state.select("source", "ranges"), more, few), "mix-more")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; of rows with equal id, source and size the first by text get
    what some of them have more."""
    key = ("source", "doc_id", "size")
    found = mix(docs, **options).groupBy(*key)
    least = F.min("copies")  # equal rows have as many copies, but for some that have one more
    copies = found.agg(F.max("copy_of").alias("_last"), least.alias("_least"), (F.sum("copies") - F.max("copy_of") * least).alias("_more"))
    other = copies.select(*(F.col(c).alias(f"_{c}") for c in key), "_last", "_least", "_more")
    sized = docs.withColumn("_words", words("text"))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_words") == F.col("_size"))
    joined = sized.join(other, same)
    alone = joined.where("_last = 1").withColumn("_n", F.col("_least"))
    place = F.row_number().over(Window.partitionBy("_source", "_doc_id", "_size").orderBy("text"))
    several = joined.where("_last > 1").withColumn("_n", F.col("_least") + (place <= F.col("_more")).cast("long"))
    each = alone.unionByName(several).withColumn("_each", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))))
    return each.select(*docs.columns)


def _joined(df: DataFrame, by_source: DataFrame, few: bool) -> DataFrame:
    """Left join of a table with a row a source (null too), sent to all tasks if there are few; else the keys are salted,
    so that a source with many documents is no single task's."""
    other = by_source.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if few:
        return df.join(F.broadcast(other), same, "left").drop("_source")
    other = other.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*(c for c in df.columns if c != "source")), F.lit(SALTS)).cast("int"))
    return salted.join(other, same & (F.col("_salt") == F.col("_salt_of")), "left").drop("_source", "_salt", "_salt_of")


def _oracle(most: int = 3, seed: str = "mix", near: float = NEAR) -> str:
    """DuckDB SQL of op4: the same definition, with a walk down the order of each source, document by document."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM d GROUP BY source),
s1 AS (SELECT *, (sid - 1) % 3 + 1 AS weight FROM s0),
s2 AS (SELECT *, {most}.0::DOUBLE * source_size / weight AS cap_level FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - {most}.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY cap_level, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (ORDER BY cap_level, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s2),
s4 AS (SELECT *, max(level) OVER () AS final FROM s3),
s5 AS (SELECT source, sid, source_size, least({most}.0::DOUBLE * source_size, final * weight) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS certain FROM s5),
s AS (SELECT *, target - certain * source_size::DOUBLE AS extra FROM s6),
e0 AS (SELECT sid, doc_id, size, (length(bin(size)) - 1) // 2 AS class, row_number() OVER (PARTITION BY sid, doc_id, size) AS copy_of
  FROM d JOIN s0 ON d.source IS NOT DISTINCT FROM s0.source),
c0 AS (SELECT sid, class, sum(size) AS words, pow(2.0::DOUBLE, class) AS w FROM e0 WHERE size > 0 GROUP BY sid, class),
c1 AS (SELECT sid, class, words, w, (extra - coalesce(sum(words) OVER (PARTITION BY sid ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(w * words::DOUBLE) OVER (PARTITION BY sid ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c0 JOIN s USING (sid)),
c AS (SELECT sid, class, words, least(1.0::DOUBLE, max(level) OVER (PARTITION BY sid) * w) AS chance FROM c1),
sampled AS (SELECT sid, CAST(floor(extra - sum(CASE WHEN chance >= 1 THEN words ELSE 0 END)::DOUBLE) AS BIGINT) AS room, target FROM c JOIN s USING (sid) GROUP BY sid, extra, target),
e1 AS (SELECT e0.*, coalesce(chance, 0) AS chance,
  (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '-') || ':' || size || ':' || copy_of), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM e0 LEFT JOIN c ON c.sid = e0.sid AND c.class = e0.class AND e0.size > 0),
e2 AS (SELECT *, (u / (1 - u)) * ((1 - chance) / chance) AS rank FROM e1 WHERE chance > 0 AND chance < 1),
o AS MATERIALIZED (SELECT sid, doc_id, size, copy_of, row_number() OVER (PARTITION BY sid ORDER BY rank, doc_id NULLS FIRST, size, copy_of) AS k FROM e2),
walk AS (
  SELECT sid, 0::BIGINT AS k, room, target, false AS took FROM sampled
  UNION ALL
  SELECT w.sid, o.k, CASE WHEN o.size <= w.room AND w.room > w.target * {near} THEN w.room - o.size ELSE w.room END, w.target, o.size <= w.room AND w.room > w.target * {near}
  FROM walk w JOIN o ON o.sid = w.sid AND o.k = w.k + 1),
short AS (SELECT sid, min(room) AS room FROM walk GROUP BY sid, target HAVING min(room) > target * {near}),
one AS (SELECT o.sid, arg_min(o.k, (abs(o.size - short.room), o.k)) AS k FROM o JOIN walk w ON w.sid = o.sid AND w.k = o.k JOIN short ON short.sid = o.sid WHERE NOT took AND o.size < 2 * short.room GROUP BY o.sid),
more AS (SELECT o.sid, doc_id, size, copy_of FROM o JOIN walk w ON w.sid = o.sid AND w.k = o.k LEFT JOIN one ON one.sid = o.sid WHERE took OR one.k = o.k)
SELECT e1.doc_id, e1.size, s.source_size, s.target, (s.certain + (e1.chance >= 1)::INT + (m.sid IS NOT NULL)::INT) * e1.size AS taken
FROM e1 JOIN s ON s.sid = e1.sid LEFT JOIN more m ON m.sid = e1.sid AND m.doc_id IS NOT DISTINCT FROM e1.doc_id AND m.size = e1.size AND m.copy_of = e1.copy_of
"""


ORACLE_SQL = _oracle()
