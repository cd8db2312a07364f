"""Set operations, and bag operations that keep multiplicity.

Nulls count as equal, as in SQL set operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_LEFT = "left_copies"
_RIGHT = "right_copies"
_PIECE = "piece"

# Copies of one row are written out in pieces of this size, by separate tasks.
COPIES_PER_PIECE = 1_000_000


def set_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of either side."""
    return left.unionByName(right).distinct()


def set_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that are on both sides."""
    return _counted(left, right).where((F.col(_LEFT) > 0) & (F.col(_RIGHT) > 0)).select(left.columns)


def set_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the left that are not on the right."""
    return _counted(left, right).where((F.col(_LEFT) > 0) & (F.col(_RIGHT) == 0)).select(left.columns)


def bag_intersect(
    left: DataFrame, right: DataFrame, copies_per_piece: int = COPIES_PER_PIECE
) -> DataFrame:
    """Rows on both sides, each as often as on the side that has fewer."""
    return _written_out(left, right, F.least(_LEFT, _RIGHT), copies_per_piece)


def bag_except(
    left: DataFrame, right: DataFrame, copies_per_piece: int = COPIES_PER_PIECE
) -> DataFrame:
    """Rows of the left, each as often as it has more copies there than on the right."""
    return _written_out(left, right, F.col(_LEFT) - F.col(_RIGHT), copies_per_piece)


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows of both sides, with their copies on each.

    One aggregation, combined on the map side, so copies do not travel. A join
    that lets null equal null would shuffle both sides once more.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return (
        left.select("*", one.alias(_LEFT), none.alias(_RIGHT))
        .unionByName(right.select("*", none.alias(_LEFT), one.alias(_RIGHT)))
        .groupBy(*left.columns)
        .agg(F.sum(_LEFT).alias(_LEFT), F.sum(_RIGHT).alias(_RIGHT))
    )


def _written_out(
    left: DataFrame, right: DataFrame, copies: Column, copies_per_piece: int
) -> DataFrame:
    """Each distinct row as often as `copies` says; a row with very many copies
    is written out by several tasks."""
    copied = (
        _counted(left, right).select(*left.columns, copies.alias("copies")).where("copies > 0")
    )
    size = F.lit(copies_per_piece).cast("bigint")
    first, last = F.lit(0).cast("bigint"), F.col("copies") - 1
    pieces = copied.select(
        *left.columns, "copies", F.explode(F.sequence(first, last, size)).alias(_PIECE)
    ).repartition(*left.columns, _PIECE)
    end_of_piece = F.least(F.col(_PIECE) + size - 1, last)
    return pieces.select(
        *left.columns, F.explode(F.sequence(F.col(_PIECE), end_of_piece)).alias("copy")
    ).drop("copy")
