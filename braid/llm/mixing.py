"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braid.llm.common import documents, fresh, text_or_empty, written

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is taken more often than this.
CAP = 3.0
#: For each weight, how its sources' share changes over training: (time, factor) from 0 to 1, linear between.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
#: Hex digits of the hash that deal a source's documents to prefix-sum buckets: 4096 buckets.
DIGITS = 3


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("no_src"),
        F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        order.alias("ord"),
        F.substring(order, 1, DIGITS).alias("bucket"),
    )


def targets(sizes: DataFrame, weights, cap: float) -> DataFrame:
    """(src, no_src, source_size, klass, target): shares by weight, filled up to cap times the source's size.

    Sorted by cap * size / weight, the sources that stop at their cap are a prefix: level k is what a unit of weight gets when
    the first k are at their caps, and the first k whose own ratio reaches its level ends the prefix. One row per source: the
    ranks over all sources are sorted in one task, so sources are meant to be collections (up to some millions), not addresses.
    """
    by_name = Window.orderBy("no_src", "src")
    by_ratio = Window.orderBy("ratio", "no_src", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    named = sizes.withColumn("klass", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("klass") + 1)
    ranked = (
        named.withColumn("weight", weight)
        .withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped", cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(onward))
    )
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "no_src", "src", "level"))).over(every)["level"]
    return ranked.withColumn("fill", level).select(
        "src", "no_src", "source_size", "klass", F.least(cap * F.col("source_size"), F.col("weight") * F.coalesce("fill", F.lit(0.0))).alias("target")
    )


def integral(schedule) -> list[float]:
    """The schedule's integral up to each of its times."""
    out = [0.0]
    for (t0, f0), (t1, f1) in zip(schedule, schedule[1:]):
        out.append(out[-1] + (t1 - t0) * (f0 + f1) / 2)
    return out


def inverted(demand: Column, schedule) -> Column:
    """The time at which the schedule's integral reaches this share of its whole."""
    sums = integral(schedule)
    out = F.lit(schedule[-1][0])
    for (t0, f0), (t1, f1), below, above in reversed(list(zip(schedule, schedule[1:], sums, sums[1:]))):
        rest = demand * sums[-1] - F.lit(below)
        slope = (f1 - f0) / (t1 - t0)
        # of slope x^2 / 2 + f0 x = rest, the root that holds for a slope of 0 too
        x = 2 * rest / (f0 + F.sqrt(F.greatest(F.lit(f0 * f0) + 2 * slope * rest, F.lit(0.0))))
        out = F.when(demand * sums[-1] < F.lit(above), t0 + x).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = CAP, schedules=SCHEDULES, positions: bool = False) -> DataFrame:
    """One row per input row, sorted by position: id_col, size, source_size, target, taken, position,
    and positions if asked for.

    A source's documents stand in one order, by a hash of their ids, and are passed through again and again until its target is
    reached, so its taken words are its target without the fraction of a word and at most one document is cut. position is the
    time from 0 to 1 at which the source's integrated schedule asks for the document's first word; null if nothing is taken.
    positions has one such time for each pass that takes a word of the document.

    The order's running sums come from 4096 hash buckets per source: sums per bucket, then a running sum over buckets, then over
    the rows of a bucket. So a source that holds most rows is spread over all tasks. Only ids, sources and sizes are exchanged.

    Null texts and texts without words have size 0 and are never taken. A null source is one source, after all others. Rows that
    repeat an id are rows of their own; ties in the order go by id, then size. Empty tables give empty results.
    """
    rows = written(sized(docs, id_col, text_col, source_col), "sizes")
    source = ["src", "no_src"]
    buckets = rows.groupBy(*source, "bucket").agg(F.sum("size").alias("in_bucket"))
    goals = targets(buckets.groupBy(*source).agg(F.sum("in_bucket").alias("source_size")), weights, cap)
    ahead = Window.partitionBy(*source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0))).join(goals, source).drop("in_bucket")
    within = Window.partitionBy(*source, "bucket").orderBy("ord", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("offset") + F.sum("size").over(within) - F.col("size")
    placed = rows.join(offsets, [*source, "bucket"]).withColumn("start", start).withColumn("goal", F.floor("target"))
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("start") - k * F.col("source_size"))) for k in range(int(-(-cap // 1)))]
    taken = reduce(lambda a, b: a + b, passes)

    def when(k: int) -> Column:
        demand = (F.col("start") + k * F.col("source_size")) / F.col("target")
        return reduce(lambda out, c: F.when(F.col("klass") == c, inverted(demand, schedules[c % len(schedules)])).otherwise(out), range(len(weights)), F.lit(None).cast("double"))

    each = F.filter(F.array(*[F.when(n > 0, when(k)) for k, n in enumerate(passes)]), lambda x: x.isNotNull())
    out = placed.withColumn("taken", taken.cast("long")).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, when(0)).alias("position"), *([each.alias("positions")] if positions else [])
    )
    return out.orderBy("position", id_col)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).withColumn("target", F.round("target", 4)).withColumn("position", F.round("position", 6))


def _position_sql(schedules=SCHEDULES) -> str:
    cases = []
    for k, schedule in enumerate(schedules):
        sums, case = integral(schedule), ""
        for (t0, f0), (t1, f1), below, above in zip(schedule, schedule[1:], sums, sums[1:]):
            slope = (f1 - f0) / (t1 - t0)
            rest = f"(start / target * {sums[-1]!r}::DOUBLE - {below!r}::DOUBLE)"
            case += f" WHEN start / target * {sums[-1]!r}::DOUBLE < {above!r}::DOUBLE THEN {t0!r}::DOUBLE + 2 * {rest} / ({f0!r}::DOUBLE + sqrt(greatest({f0 * f0!r}::DOUBLE + 2 * {slope!r}::DOUBLE * {rest}, 0)))"
        cases.append(f" WHEN klass = {k} THEN CASE{case} ELSE {schedule[-1][0]!r}::DOUBLE END")
    return f"CASE{''.join(cases)} END"


OP7_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS klass
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE klass WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, sum(source_size) OVER ()::DOUBLE AS total FROM sources),
filled AS (
  SELECT *, 3 * source_size / weight AS ratio,
         3 * coalesce(sum(source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
         sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others
  FROM weighed),
level AS (SELECT first((total - capped) / others ORDER BY ratio, source NULLS LAST) AS fill FROM filled WHERE ratio >= (total - capped) / others),
goals AS (SELECT source, source_size, klass, least(3.0::DOUBLE * source_size, weight * coalesce(fill, 0)) AS target FROM filled, level),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.klass,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::DOUBLE AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (
  SELECT *, (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size))
             + greatest(0, least(size, floor(target) - start - 2 * source_size)))::BIGINT AS taken
  FROM placed)
SELECT doc_id, size, source_size, round(target, 4) AS target, taken,
       round(CASE WHEN taken > 0 THEN {_position_sql()} END, 6) AS position
FROM mixed
"""


def op7_mixing_passes(spark, sf_dir: str) -> DataFrame:
    """A row for each pass that takes a word of a document, in training order; op7_mixing has the first pass's position only."""
    out = mix(documents(spark, sf_dir), positions=True).select("doc_id", F.posexplode("positions").alias("pass", "position"))
    return out.orderBy("position", "doc_id", "pass")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, each copy at its own position: rows are range-sorted by position.

    The document that a target would cut stays if half of it or more is taken. Documents without words stay once, before all
    others: they take nothing from any target. Rows that repeat an id go by the largest number of copies.
    """
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).cast("int")
    where = F.when(F.col("size") == 0, F.array(F.lit(None).cast("double"))).otherwise(F.slice("positions", F.lit(1), F.greatest(copies, F.lit(0))))
    own, mixed, position = (fresh(docs, c) for c in ("__id", "__mix", "__position"))
    taken = (
        mix(docs, positions=True)
        .select(F.col("doc_id").alias(own), F.struct(copies.alias("copies"), where.alias("where")).alias(mixed))
        .groupBy(own)
        .agg(F.max(mixed).alias(mixed))
        .filter(f"{mixed}.copies > 0")
    )
    out = docs.join(taken.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(taken[own]))
    out = out.withColumn(position, F.explode(f"{mixed}.where")).orderBy(position, docs["doc_id"])
    return out.select(*[docs[c] for c in docs.columns])
