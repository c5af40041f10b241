"""As-of join: each left row with the latest right row of its key that is not after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError
from plumbline.functions.columns import col, require_columns
from plumbline.operators.scans import Measures, segmented_scan


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    tie_order: Sequence[str] = (),
    strict: bool = False,
    how: str = "left",
    suffix: str = "_right",
    partitions: int | None = None,
) -> DataFrame:
    """``left`` with the columns of the right row of the same ``by`` whose ``on`` is the latest not after the left row's.

    Both sides become one ordered table, and the last right row seen is carried
    along, over the borders of ranges too, so no range join is needed and a key
    with most of the rows is spread like any other. Of right rows with equal
    ``by`` and ``on`` the last in ``tie_order`` (right columns) counts, of those
    equal in it, too, any one. ``strict`` leaves out equal ``on``. A null in ``by`` or ``on``
    matches nothing. ``how`` "left" keeps left rows without a match, "inner"
    drops them. Right columns whose names the left has get ``suffix``.
    """
    require_columns(left, [*by, on])
    require_columns(right, [*by, on, *tie_order])
    if how not in ("left", "inner"):
        raise PlumblineError(f"how must be left or inner, got {how}")
    taken, names = set(left.columns), {}
    for name in right.columns:
        if name in by:
            continue
        new = f"{name}{suffix}" if name in taken else name
        if new in taken:
            raise PlumblineError(f"cannot find a free name for column {name}")
        taken.add(new)
        names[name] = new
    place = {b: f"__b{i}" for i, b in enumerate(by)}
    head = [*(col(b).alias(place[b]) for b in by), col(on).alias("__on")]
    there = [col(c).isNotNull() for c in [*by, on]]
    for condition in there:
        right = right.where(condition)
    ties = [col(t).alias(f"__t{i}") for i, t in enumerate(tie_order)]
    right_rows = right.select(*head, F.lit(1 if strict else 0).alias("__side"), *ties, F.struct(*[col(c) for c in right.columns]).alias("__right"))
    left_rows = left.select(*head, F.lit(0 if strict else 1).alias("__side"), F.lit(True).alias("__is_left"), F.struct(*[col(c) for c in left.columns]).alias("__left"))
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    order = [F.col("__on").asc_nulls_first(), "__side", *[f"__t{i}" for i in range(len(ties))]]
    # Many left rows may be equal in all this; a hash of the row lets them be dealt to several ranges.
    hashed = [F.col("__left").getField(f.name) for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = both.withColumn("__spread", F.xxhash64(*hashed))
    seen = segmented_scan(spread, list(place.values()), [*order, "__spread"], Measures(last={"__found": "__right"}), partitions)
    rows = seen.where("__is_left")
    if how == "inner":
        rows = rows.where("__found IS NOT NULL")
    kept = [F.col("__left").getField(c).alias(c) for c in left.columns]
    return rows.select(*kept, *[F.col("__found").getField(c).alias(new) for c, new in names.items()])
