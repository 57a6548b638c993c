"""Windows over one long order, cut into pieces that many tasks work on.

What a window needs of all rows before is small: the last row's values, or a product. So each piece works by itself, the
pieces' ends are carried from piece to piece in a table of one row per piece, and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundperf.constants import HOLDING_KEY
from fundperf.operators.carried import CARRIED

#: Names that ``lag_state`` gives the previous row's values.
PREVIOUS = {
    "side": "previous_side",
    "shares_1": "previous_shares",
    "price_1": "previous_price",
    "fx_rate_1": "previous_fx_rate",
}
SLICE = "_slice"


def lag_state_sliced(merged: DataFrame, unit: str = "year") -> DataFrame:
    """The rows of ``lag_state`` from slices of time: a task has one holding's rows of one ``unit``, not of all history.

    The last row of each slice is carried to the holding's next slice that has rows. Carried rows are as many as holdings
    and slices; the rows themselves are shuffled once, by holding and slice, and the carried ones join them there.
    """
    keys = [*HOLDING_KEY, SLICE]
    sliced = merged.withColumn(SLICE, F.trunc("caldt", unit))
    order = [F.col("caldt"), F.col("action_id")]
    within = Window.partitionBy(*keys).orderBy(*order)
    lagged = sliced.select(
        "*", F.row_number().over(within).alias("_place"), *[F.lag(name).over(within).alias(PREVIOUS[name]) for name in CARRIED]
    )
    ends = sliced.groupBy(*keys).agg(F.max_by(F.struct(*CARRIED), F.struct("caldt", "action_id")).alias("_end"))
    before = Window.partitionBy(*HOLDING_KEY).orderBy(SLICE)
    carried = ends.select(*keys, F.lag("_end").over(before).alias("_carried")).filter("_carried IS NOT NULL")
    joined = lagged.join(carried, keys, "left")
    first = F.col("_place") == 1
    return joined.select(
        *merged.columns,
        *[F.when(first, F.col("_carried")[name]).otherwise(F.col(PREVIOUS[name])).alias(PREVIOUS[name]) for name in CARRIED],
    )


def ranged(df: DataFrame, order: str, pieces: int, span: tuple[date, date] | None = None) -> DataFrame:
    """Rows dealt into ``pieces`` ranges of a day column, numbered in ``_piece``; equal days stay in one range.

    With a ``span`` of days the ranges are equally long, which suits rows of about one a day. Otherwise they begin at
    quantiles, which one pass over the days finds, and hold about as many rows each.
    """
    value = F.unix_date(order)
    if span is not None:
        first, days = (span[0] - date(1970, 1, 1)).days, (span[1] - span[0]).days + 1
        piece = F.floor((value - first) * pieces / days).cast("int")
        return df.withColumn("_piece", F.greatest(F.lit(0), F.least(F.lit(pieces - 1), piece)))
    at = [i / pieces for i in range(1, pieces)] or [0.0]
    cuts = df.agg(F.percentile_approx(value, at, 100 * pieces)).first()[0] or []  # as many as pieces
    known = F.array(*[F.lit(cut) for cut in sorted(set(cuts))]).cast("array<int>")
    return df.withColumn("_piece", F.size(F.filter(known, lambda cut: cut <= value)))


def previous_value(df: DataFrame, value: str, name: str, order: str = "caldt", pieces: int = 8) -> DataFrame:
    """The value of the row before in one global order of days, each of one row, without one task for all rows.

    As ``lag(value) OVER (ORDER BY order)``. Only each piece's last row goes through a window over the pieces.
    """
    rows = ranged(df, order, pieces)
    within = Window.partitionBy("_piece").orderBy(order)
    lagged = rows.select("*", F.row_number().over(within).alias("_place"), F.lag(value).over(within).alias("_before"))
    ends = rows.groupBy("_piece").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_end"))
    carried = ends.select("_piece", F.lag("_end").over(Window.orderBy("_piece")).alias("_carried"))
    joined = lagged.join(F.broadcast(carried), "_piece")  # a row per piece
    before = F.when(F.col("_place") == 1, F.col("_carried.v")).otherwise(F.col("_before"))
    return joined.select(*df.columns, before.alias(name))


def running_returns(
    df: DataFrame,
    returns: dict[str, Column],
    order: Sequence[str] = ("caldt",),
    pieces: int = 8,
    span: tuple[date, date] | None = None,
) -> DataFrame:
    """Compounded returns up to each row of one global order, by prefix scan: NULL on rows without a daily return.

    Each piece multiplies its own rows; the products of the pieces before it, one row per piece, are multiplied in.
    ``returns`` maps new columns to daily returns; rows without one are skipped by later rows.
    """
    rows = ranged(df, order[0], pieces, span)
    within = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *[F.product(r + 1.0).over(within).alias(f"_own_{name}") for name, r in returns.items()])
    whole = rows.groupBy("_piece").agg(*[F.product(r + 1.0).alias(f"_all_{name}") for name, r in returns.items()])
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        "_piece", *[F.coalesce(F.product(f"_all_{name}").over(before), F.lit(1.0)).alias(f"_before_{name}") for name in returns]
    )
    joined = own.join(F.broadcast(carried), "_piece")  # a row per piece
    return joined.select(
        *df.columns,
        *[
            F.when(r.isNotNull(), F.col(f"_own_{name}") * F.col(f"_before_{name}") - 1.0).alias(name)
            for name, r in returns.items()
        ],
    )
