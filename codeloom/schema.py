"""Table contracts: required columns, their types and value checks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.errors import InvalidInput


@dataclass(frozen=True)
class Contract:
    """Required columns in order. Other columns are kept behind them."""

    name: str
    columns: tuple[tuple[str, T.DataType], ...]
    coerce: bool = True
    not_negative: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.columns]


_S = T.StringType()

SEARCH_INPUT = Contract("search input", (("id", _S), ("query", _S)))
SEARCH_OUTPUT = Contract(
    "search output",
    (
        ("query_id", _S),
        ("query_text", _S),
        ("doc_id", _S),
        ("doc_text", _S),
        ("rank", T.IntegerType()),
        ("score", T.DoubleType()),
    ),
    not_negative=("rank",),
)
REVERSE_INPUT = Contract("reverse search input", (("id", _S), ("doc_id", _S)))
REVERSE_OUTPUT = Contract(
    "reverse search output", (("id", _S), ("doc_id", _S), ("doc_text", _S)), coerce=False
)
EMBED_INPUT = Contract("embed input", (("id", _S), ("text", _S)))
EMBED_OUTPUT = Contract(
    "embed output", (("id", _S), ("text", _S), ("embedding", T.ArrayType(T.FloatType())))
)


def named(column: str) -> Column:
    """A top-level column by its name, which may hold dots and backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def _is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` with the contract's columns first, in order and type.

    Missing columns and wrong types are reported at once; value checks run with
    the job and stop it at the first bad row.
    """
    missing = [c for c in contract.names if c not in df.columns]
    if missing:
        raise InvalidInput(f"{contract.name}: missing columns {missing}, got {df.columns}")
    selected = []
    for name, kind in contract.columns:
        column, actual = F.col(name), df.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            if not _is_vector(actual):
                raise InvalidInput(f"{contract.name}: {name} must be an array of floats, is {actual.simpleString()}")
        elif contract.coerce:
            column = column.cast(kind)
        elif actual != kind:
            raise InvalidInput(f"{contract.name}: {name} must be {kind.simpleString()}, is {actual.simpleString()}")
        if name in contract.not_negative:
            message = F.lit(f"{contract.name}: {name} must not be negative")
            column = F.when(column >= 0, column).otherwise(F.raise_error(message).cast(kind))
        selected.append(column.alias(name))
    return df.select(*selected, *[named(c) for c in added_columns(df, contract)])


def added_columns(df: DataFrame, contract: Contract, also: Iterable[str] = ()) -> list[str]:
    """Columns beyond the contract (and ``also``): metadata and what hooks have added."""
    known = {*contract.names, *also}
    return [c for c in df.columns if c not in known]


def require_positive(name: str, value: int, unlimited: bool = False) -> None:
    """Check a count argument; ``unlimited`` also admits -1."""
    whole = isinstance(value, int) and not isinstance(value, bool)
    if not whole or (value < 1 and not (unlimited and value == -1)):
        raise InvalidInput(f"{name} must be an integer >= 1{' or -1' if unlimited else ''}, got {value!r}")


def require_rows(df: DataFrame, name: str) -> None:
    if df.isEmpty():
        raise InvalidInput(f"{name} is empty")
