"""Rules in which each decision depends on the one before, run without gathering a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StructField, StructType


def keep_in_order(df: DataFrame, key: str, order: list[str], start: object, decide: Callable[[object, object], tuple[bool, object]], value: str | list[str]) -> DataFrame:
    """The rows that ``decide`` keeps, as ``flag_in_order`` flags them."""
    return flag_in_order(df, key, order, start, decide, value, "_keep").where("_keep").drop("_keep")


def flag_in_order(df: DataFrame, key: str, order: list[str], start: object, decide: Callable[[object, object], tuple[bool, object]], value: str | list[str], flag: str) -> DataFrame:
    """Adds the boolean ``flag``, by ``decide`` going through each key's rows in ``order``.

    ``decide(state, value)`` gives the flag and what the state is then (of several columns,
    a tuple of their values); each key begins at ``start``. Rows are dealt by key and sorted by
    Spark, which can spill, and stream through a task batch by batch, so memory holds one
    batch and one state however many rows a key has. A null key is a key; rows with a null
    value are left out.
    """
    columns = [value] if isinstance(value, str) else value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, start, False
        for b in batches:
            found = []
            given = b[value].tolist() if isinstance(value, str) else zip(*(b[c].tolist() for c in columns))
            for k, v in zip(b[key].tolist(), given):
                k = None if pd.isna(k) else k
                if not begun or k != now:
                    now, state, begun = k, start, True
                ok, state = decide(state, v)
                found.append(ok)
            b[flag] = found
            yield b

    schema = StructType([*df.schema.fields, StructField(flag, BooleanType())])
    there = df.dropna(subset=columns)
    return there.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
