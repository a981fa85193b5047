"""Handlers by name: scalar column functions, and a table function for list ports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text

#: ``module:callable`` of each handler that may be called by name; others are refused.
HANDLERS: dict[str, Callable[[Column], Column]] = {
    "text:clean_caption": text.clean_caption,
    "text:endpoint": text.endpoint,
    "text:redact": text.redact,
    "text:object_key": text.object_key,
}


def handler(name: str) -> Callable[[Column], Column]:
    if name not in HANDLERS:
        raise KeyError(f"unknown handler {name!r}; known: {sorted(HANDLERS)}")
    return HANDLERS[name]


def dispatch(name: Column, value: Column, names: list[str]) -> Column:
    """The value through the handler that each row names, of ``names``; null for other names."""
    out = F.lit(None).cast("string")
    for n in names:
        out = F.when(name == n, handler(n)(value)).otherwise(out)
    return out


class ListPort:
    """Table function: the numbered parts of a text, one row each."""

    def eval(self, value: str, separator: str) -> Iterator[tuple[int, str]]:
        if value is not None:
            yield from enumerate(value.split(separator))


def register(spark: SparkSession) -> None:
    """Make ``list_port(value, separator)`` callable from SQL."""
    spark.udtf.register("list_port", F.udtf(ListPort, returnType="place int, part string"))
