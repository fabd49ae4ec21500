"""Joins on time: intervals that overlap, and the last row before a moment. No pair meets but in a common bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.ordered import last_values

#: Bins of one level are so many times as wide as those of the level below, and there are so many levels.
FACTOR, LEVELS = 8, 12


def _levelled(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Intervals with their own level, whose bins are at least an eighth as long as they are."""
    length = F.col(end) - F.col(start)
    own = F.lit(LEVELS - 1)
    for level in range(LEVELS - 2, -1, -1):
        own = F.when(length <= width * FACTOR ** (level + 1), F.lit(level)).otherwise(own)
    return rows.filter(F.col(start) <= F.col(end)).withColumn("_level", own)


def _binned(rows: DataFrame, start: str, end: str, width: int, levels: Column, asked: DataFrame | None = None) -> DataFrame:
    """A row for each bin that an interval takes part in, of each of `levels` that is asked for; of a wider level than its own it meets two bins at most."""
    rows = rows.select("*", F.explode(levels).alias("_at"))
    if asked is not None:
        rows = rows.join(asked, "_at", "left_semi")
    size = F.lit(width) * F.pow(F.lit(FACTOR), F.col("_at")).cast("long")
    bin_of = lambda c: F.floor(F.col(c) / size).cast("long")
    return rows.withColumn("_first", bin_of(start)).select("*", F.explode(F.sequence(F.col("_first"), bin_of(end))).alias("_bin"))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """All pairs with equal `on` whose closed intervals overlap: the columns of both sides, `on` once.

    Spans name long columns, start and end; `width` is the narrowest bin, about a usual length. A pair meets in bins of the
    longer interval's level alone and is told in the later of the first bins of the two, so once: short intervals never meet
    in the wide bins that longer ones need. A hot key is parted by its bins, and a long interval is a few rows in wide bins.
    Intervals with a null or that end before they start overlap nothing; null keys match nothing. Other columns of the two
    sides need different names.
    """
    names = lambda rows: [c for c in rows.columns if c not in on]
    a, b = _levelled(left, *left_span, width), _levelled(right, *right_span, width)
    one, wider = F.array("_level"), F.sequence(F.col("_level"), F.lit(LEVELS - 1))

    def met(long: DataFrame, long_span: tuple[str, str], short: DataFrame, short_span: tuple[str, str], above: Column) -> DataFrame:
        # only levels that the longer side has, a dozen numbers at most
        asked = F.broadcast(long.select(F.col("_level").alias("_at")).distinct())
        wide = _binned(long, *long_span, width, one).drop("_level").withColumnRenamed("_first", "_fa")
        narrow = _binned(short, *short_span, width, above, asked).drop("_level").withColumnRenamed("_first", "_fb")
        overlap = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
        rows = wide.join(narrow, [*on, "_at", "_bin"]).filter((F.col("_bin") == F.greatest("_fa", "_fb")) & overlap)
        return rows.select(*on, *names(left), *names(right))

    equal_or_wider = met(a, left_span, b, right_span, wider)
    return equal_or_wider.unionAll(met(b, right_span, a, left_span, F.filter(wider, lambda x: x > F.col("_level"))))


def asof_join(left: DataFrame, right: DataFrame, on: list[str], at: str, ties: str, value: Column, out: str) -> DataFrame:
    """Each row of `left` with the `value` of the last row of `right` with the same `on` at its time or before, else null.

    Both sides have `on`, `at` and `ties`, which orders rows of one side at one time. Rows of a key of any number are parted by
    ranges of time, and the last value is carried from range to range. Null times come first.
    """
    kept = left.columns
    rows = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType))
    marks = right.select(*on, at, ties, F.lit(0).alias("_side"), value.alias("_value"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # a value that is null is still the last: wrapped, so that it isn't passed over
    seen = last_values(both, on, [at, "_side", ties], F.when(F.col("_side") == 0, F.struct(F.col("_value").alias("v"))), "_last")
    return seen.filter("_side = 1").select(*kept, F.col("_last.v").alias(out))
