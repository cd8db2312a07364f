"""As-of join: the latest right row at or before each left row's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .running import carry_forward

_TIME = "asof_time"
_SIDE = "asof_side"
_ID = "asof_id"
_LEFT = "left_row"
_RIGHT = "right_row"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
) -> DataFrame:
    """Each left row with the columns of the latest right row of the same keys
    whose time is not later; nulls where there is none.

    Of right rows at the same time the one with the largest id wins. The sides
    are laid in one sequence per key and the last right row is carried along,
    which takes one shuffle of each and never pairs rows. Apart from the keys,
    column names must differ.
    """
    taken = [c for c in right.columns if c not in keys]
    right = right.dropna(subset=[*keys, right_time])
    right_type = right.select(*taken).schema
    questions = left.select(
        *keys,
        F.col(left_time).alias(_TIME),
        F.lit(1).alias(_SIDE),
        F.col(left_id).alias(_ID),
        F.struct(*left.columns).alias(_LEFT),
        F.lit(None).cast(right_type).alias(_RIGHT),
    )
    answers = right.select(
        *keys,
        F.col(right_time).alias(_TIME),
        F.lit(0).alias(_SIDE),
        F.col(right_id).alias(_ID),
        F.lit(None).cast(left.schema).alias(_LEFT),
        F.struct(*taken).alias(_RIGHT),
    )
    sequence = carry_forward(
        questions.unionByName(answers), keys, [_TIME, _SIDE, _ID], _RIGHT
    )
    return sequence.where(F.col(_LEFT).isNotNull()).select(f"{_LEFT}.*", f"{_RIGHT}.*")
