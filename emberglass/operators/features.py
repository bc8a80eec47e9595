"""One row of features per entity, from events of many types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ntz_us, us_ntz
from ..runtime import cut


class TooManyTypes(ValueError):
    pass


def type_list(events: DataFrame, column: str, most: int = 4000) -> list[str]:
    """The sorted types found in ``column``; fails, rather than dropping any, when there are more than ``most``."""
    found = [r[0] for r in events.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise TooManyTypes(f"{column}: more than {most} types; group them before asking for one column each")
    return sorted(found)


def feature_table(parts: list[tuple[str, DataFrame, list[str] | None, dict[str, Column], dict[str, Column]]]) -> DataFrame:
    """One row per entity over several event tables.

    Each part is ``(prefix, events(entity, kind, …), types, measures, defaults)``: its columns are ``{prefix}_{type}_{measure}`` for
    every type of the list, with the default where the entity has no such event. ``types`` of None means all types there are
    (``type_list``). An entity of any part gets a row; null entities and kinds are left out; kinds outside a list have no column.

    The events are folded by (entity, type) with map-side combine, so that an entity with a third of all events reaches the
    shuffle as one row per type and task. Those rows are brought together by entity, and one aggregation with a conditional
    value for every type of the list (Spark's pivot over given values) lays out the columns where they lie: the wide rows are
    made behind the last shuffle and never cross one.
    """
    names = list(dict.fromkeys(m for _, _, _, measures, _ in parts for m in measures))
    folded, times = [], set()
    for i, (_, events, types, measures, _) in enumerate(parts):
        known = events.where("entity is not null and kind is not null")
        known = known if types is None else known.where(F.col("kind").isin(types))
        per = known.groupBy("entity", F.concat(F.lit(f"{i}:"), F.col("kind").cast("string")).alias("kind")).agg(*[c.alias(m) for m, c in measures.items()])
        of = dict(per.dtypes)
        times |= {(m, of[m]) for m in measures if of[m] in ("timestamp", "timestamp_ntz")}
        whole = {"timestamp": lambda m: F.unix_micros(m), "timestamp_ntz": lambda m: ntz_us(F.col(m))}  # numbers are pivoted in fixed places
        folded.append(per.select("entity", "kind", *[whole.get(of[m], F.col)(m).alias(m) if m in of else F.lit(None).alias(m) for m in names]))
    per = reduce(DataFrame.unionByName, folded)
    lists = [types for _, _, types, _, _ in parts]
    if None in lists:
        per = cut(per)
        lists = [type_list(per.where(F.col("kind").startswith(f"{i}:")).select(F.substring("kind", len(f"{i}:") + 1, 1 << 30).alias("kind")), "kind") if types is None else types for i, types in enumerate(lists)]
    values = [f"{i}:{t}" for i, types in enumerate(lists) for t in types]
    if not values:
        return per.select("entity").distinct()
    wide = per.repartition("entity").groupBy("entity").pivot("kind", values).agg(*[F.first(m).alias(m) for m in names])
    wide = wide.toDF("entity", *[f"{v}_{m}" for v in values for m in names])
    back = {m: (F.timestamp_micros if kind == "timestamp" else us_ntz) for m, kind in times}
    columns = [F.col("entity")]
    for i, (prefix, _, _, measures, defaults) in enumerate(parts):
        for t in lists[i]:
            for m in measures:
                name = f"{i}:{t}_{m}".replace("`", "``")
                cell = back.get(m, lambda c: c)(F.col(f"`{name}`"))
                columns.append((F.coalesce(cell, defaults[m]) if m in defaults else cell).alias(f"{prefix}_{t}_{m}"))
    return wide.select(*columns)
