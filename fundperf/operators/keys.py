"""Key checks and keyed writes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.functions.bounds import broadcast_within, day_span, in_window


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The same rows, with a failing job where a key occurs more than once."""
    keys = list(keys)
    values = [name for name in df.columns if name not in keys]
    failure = f"raise_error('{what}: more than one row per ({', '.join(keys)})')"
    firsts = [F.expr(f"first(`{name}`) AS `{name}`") for name in values]
    return (
        df.groupBy(*keys)
        .agg(F.expr("count(1) AS _copies"), *firsts)
        .selectExpr(
            *keys, *[f"CASE WHEN _copies = 1 THEN `{name}` ELSE {failure} END AS `{name}`" for name in values]
        )
    )


def daily_lookup(df: DataFrame, what: str, start: str | date, end: str | date) -> DataFrame:
    """A table with one row per day, cut to a window and small enough by that to broadcast."""
    daily = require_unique(df.filter(in_window(start, end)), ["caldt"], what)
    return broadcast_within(daily, day_span(start, end))


def keyed_upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    set_cols: Sequence[str],
    row_bound: int | None = None,
) -> DataFrame:
    """Insert or update by key.

    Matched rows take ``set_cols`` from the update, NULL included, and keep their other columns.
    Unmatched updates become new rows, unmatched target rows stay. A key given twice in one
    batch fails the job.

    With a ``row_bound`` both joins against ``target`` have the batch on the build side, so a small
    batch is broadcast and the target is not shuffled. Without one, a single full outer join reads
    the target once.
    """
    keys, set_cols = list(keys), list(set_cols)
    given = updates.select(*keys, *set_cols).withColumn("_given", F.lit(True))
    batch = broadcast_within(require_unique(given, keys, "upsert batch"), row_bound)
    renamed = batch.withColumnsRenamed({name: f"_new_{name}" for name in set_cols})
    if row_bound is None:
        return target.join(renamed, keys, "full").select(
            *[
                F.when(F.col("_given"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
                if name in set_cols
                else F.col(name)
                for name in target.columns
            ]
        )
    kept = target.join(renamed, keys, "left").select(
        *[
            F.when(F.col("_given"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
            if name in set_cols
            else F.col(name)
            for name in target.columns
        ]
    )
    present = target.select(*keys).join(batch.select(*keys), keys, "left_semi")
    new = batch.join(present, keys, "left_anti").filter("_given").drop("_given")
    return kept.unionByName(new, allowMissingColumns=True)
