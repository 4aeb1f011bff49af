"""Mixing sources to target weights along a time-varying curriculum.

Each source's tokens are demanded at a rate that follows its weight schedule over the training
run. Integrating the schedule gives cumulative demand; inverting it at a document's place in its
source gives the document's time, hence its training position; a range sort by position gives
the training order. Everything is DataFrame functions: sizes and (source, bucket) sums are
partial aggregates, and running sums go over hash buckets first and rows of a bucket next, so a
source with a third of all rows is spread over all buckets.

Targets share ``share`` times the total by weight; a source's target stops at ``most`` times its
size and the excess is shared again. A document is taken whole, 0, 1 or 2 times: copy k of a
document whose words are c..c+size of its source (ordered by md5 of its id) is taken when the
middle c + k * source_size + size / 2 lies before the target. So a source's total differs from
its target by at most half of one document.

A source's order is that of md5 hashes of id and text, so rows of one id, or without one, are
spread as others are. Words are counted once for ``mix``, whose sizes are written to the shared
folder without texts; ``curriculum`` counts again where it carries the rows along.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
repeated rows are separate documents, of which any may come first; an empty table gives no rows;
input columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import WORD, written

#: Hex digits of the md5 by which a source's rows are dealt out: 4,096 buckets for each source.
DIGITS = 3


@dataclass(frozen=True)
class Curriculum:
    """Weights in the order of sources, repeating, and each weight's schedule.

    schedules[i] are the rates of a source of weights[i] at the times of ``knots`` (0 to 1);
    between knots the rate is linear. Rates are relative: the integral is scaled to the target.
    """

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    knots: tuple[float, ...] = (0.0, 0.5, 1.0)
    schedules: tuple[tuple[float, ...], ...] = ((3.0, 2.0, 1.0), (1.0, 1.0, 1.0), (1.0, 2.0, 4.0))

    def __post_init__(self):
        if len(self.schedules) != len(self.weights) or any(len(s) != len(self.knots) or min(s) <= 0 for s in self.schedules):
            raise ValueError("each weight needs a schedule with a positive rate at every knot")
        if self.knots[0] != 0 or self.knots[-1] != 1 or list(self.knots) != sorted(set(self.knots)):
            raise ValueError("knots go from 0 to 1")

    def integrals(self, i: int) -> list[float]:
        """Share of a source's demand up to each knot."""
        areas = [0.0]
        for k in range(1, len(self.knots)):
            areas.append(areas[-1] + (self.knots[k] - self.knots[k - 1]) * (self.schedules[i][k - 1] + self.schedules[i][k]) / 2)
        return areas

    def times(self, i: int, q: Column) -> Column:
        """The time at which a share q of a source's demand has been met: the inverse of its integral."""
        areas, rates = self.integrals(i), self.schedules[i]
        need = q * areas[-1]
        out = None
        for k in range(1, len(self.knots)):
            width = self.knots[k] - self.knots[k - 1]
            slope = (rates[k] - rates[k - 1]) / width
            left = need - areas[k - 1]
            if slope == 0:
                at = left / rates[k - 1]
            else:
                at = (F.sqrt(F.greatest(F.lit(0.0), rates[k - 1] ** 2 + 2 * slope * left)) - rates[k - 1]) / slope
            at = at + self.knots[k - 1]
            last = k == len(self.knots) - 1
            out = (F.when(need < areas[k], at) if out is None else out.when(need < areas[k], at)) if not last else (at if out is None else out.otherwise(at))
        return out


def sizes(df: DataFrame, key: str = "doc_id", source: str = "source", column: str = "text") -> list[Column]:
    """doc_id, source, size long, _s (the source, null told from text) and _place, by which a source is ordered."""
    text = df[column].cast("string")
    return [
        df[key].alias("doc_id"),
        df[source].cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(df[source].isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), df[source].cast("string"))).alias("_s"),
        F.md5(F.concat(F.coalesce(df[key].cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))).alias("_place"),
    ]


def targets(buckets: DataFrame, c: Curriculum) -> DataFrame:
    """One row for each source: _s, source_size, weight index and target, by filling up to the caps in one pass.

    Sources are sorted by cap over weight; a source is at its cap when the level that the
    others would reach without it is not below its own.
    """
    per = buckets.groupBy("_s", "source").agg(F.sum("_sum").alias("source_size"))
    n = len(c.weights)
    named = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("_i", (F.row_number().over(named) - 1) % n)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in c.weights]), F.col("_i") + 1)
    per = per.withColumn("_weight", weight).withColumn("_cap", c.most * F.col("source_size"))
    every = Window.partitionBy(F.lit(1))
    level = Window.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("_weight"), "_s")
    before, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("_left", c.share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    per = per.withColumn("_rest", F.sum("_weight").over(rest))
    per = per.withColumn("_full", F.col("_cap") * F.col("_rest") <= F.col("_left") * F.col("_weight"))
    per = per.withColumn("_open", F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("_weight")).alias("o"), "_s", "_left", "_rest"))).over(every))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_open._left") * F.col("_weight") / F.col("_open._rest"))
    return per.select("_s", "_i", "source_size", target.alias("target"))


def bucket_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_s", F.substring("_place", 1, DIGITS).alias("_b")).agg(F.sum("size").alias("_sum"), F.max("source").alias("source"))


def placed(rows: DataFrame, buckets: DataFrame, c: Curriculum) -> DataFrame:
    """The rows with source_size, target, copies, taken and the time of each of two copies."""
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_s", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    places = offsets.join(targets(buckets, c), "_s")
    inside = Window.partitionBy("_s", "_b").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_b", F.substring("_place", 1, DIGITS)).repartition("_s", "_b")
    rows = rows.withColumn("_inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(places, ["_s", "_b"])
    middles = [2 * (F.col("_offset") + F.col("_inner")) + 2 * k * F.col("source_size") + F.col("size") for k in range(2)]
    taken = [m < 2 * F.col("target") for m in middles]
    time = []
    for m, t in zip(middles, taken, strict=True):
        q = m / (2 * F.col("target"))
        by_weight = F.coalesce(*[F.when(F.col("_i") == i, c.times(i, q)) for i in range(len(c.weights))])
        time.append(F.when(t & (F.col("target") > 0), by_weight))
    copies = sum((F.when(t, 1).otherwise(0) for t in taken), F.lit(0)).cast("long")
    return rows.withColumns({"copies": copies, "taken": copies * F.col("size"), "time_1": time[0], "time_2": time[1]})


def mix(df: DataFrame, c: Curriculum = Curriculum(), key: str = "doc_id", source: str = "source", column: str = "text") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken, and the time of each of two copies."""
    rows = written(df.select(*sizes(df, key, source, column)), "sizes")
    return placed(rows, bucket_sums(rows), c).select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "time_1", "time_2")


def curriculum(df: DataFrame, c: Curriculum = Curriculum(), key: str = "doc_id", source: str = "source", column: str = "text") -> DataFrame:
    """The mix itself: the input's rows, once for each copy, range-sorted by training time."""
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    at = {x: names[df.columns.index(x)] for x in (key, source, column)}
    rows = plain.select(*names, *sizes(plain, at[key], at[source], at[column]))
    out = placed(rows, written(bucket_sums(rows), "sizes"), c)
    out = out.select(*names, "doc_id", F.explode(F.array_compact(F.array("time_1", "time_2"))).alias("time"))
    return out.repartitionByRange("time", "doc_id").sortWithinPartitions("time", "doc_id").select(*names).toDF(*df.columns)


def oracle(c: Curriculum = Curriculum()) -> str:
    """SQL for mix() with its default columns: caps by repeated sharing would need a loop; here by the sorted levels."""
    weights = "CASE i " + " ".join(f"WHEN {i} THEN {float(w)!r}" for i, w in enumerate(c.weights)) + " END"

    def time(i: int, q: str) -> str:
        areas, rates = c.integrals(i), c.schedules[i]
        out = "CASE "
        for k in range(1, len(c.knots)):
            slope = (rates[k] - rates[k - 1]) / (c.knots[k] - c.knots[k - 1])
            left = f"({q} * {areas[-1]!r} - {areas[k - 1]!r})"
            at = f"{left} / {rates[k - 1]!r}" if slope == 0 else f"(sqrt(greatest(0.0, {rates[k - 1] ** 2!r} + {2 * slope!r} * {left})) - {rates[k - 1]!r}) / {slope!r}"
            out += (f"WHEN {q} * {areas[-1]!r} < {areas[k]!r} THEN " if k < len(c.knots) - 1 else "ELSE ") + f"{at} + {c.knots[k - 1]!r} "
        return out + "END"

    def first(k: int) -> str:
        q = f"(CAST(2 * begins + {2 * k} * source_size + size AS DOUBLE) / (2 * target))"
        return "CASE i " + " ".join(f"WHEN {i} THEN {time(i, q)}" for i in range(len(c.weights))) + " END"

    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(c.weights)} AS i FROM d GROUP BY source),
w AS (SELECT *, CAST({weights} AS DOUBLE) AS weight, {float(c.most)!r} * source_size AS cap FROM s),
l AS (SELECT *, {float(c.share)!r} * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, cap * rest <= remaining * weight AS is_full FROM l),
o AS (SELECT remaining AS o_remaining, rest AS o_rest FROM f WHERE NOT is_full ORDER BY cap / weight, source NULLS FIRST LIMIT 1),
t AS (SELECT source, i, source_size, CASE WHEN is_full THEN cap ELSE o_remaining * weight / o_rest END AS target FROM f LEFT JOIN o ON TRUE),
p AS (SELECT d.*, i, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, 2 * begins + size < 2 * target AS take_1, 2 * begins + 2 * source_size + size < 2 * target AS take_2 FROM p)
SELECT doc_id, source, size, source_size, target, CAST(take_1 AS BIGINT) + CAST(take_2 AS BIGINT) AS copies, (CAST(take_1 AS BIGINT) + CAST(take_2 AS BIGINT)) * size AS taken,
       CASE WHEN take_1 AND target > 0 THEN round({first(0)}, 6) END AS time_1, CASE WHEN take_2 AND target > 0 THEN round({first(1)}, 6) END AS time_2
FROM k
"""
