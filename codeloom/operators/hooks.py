"""User functions that run before and after an operation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from codeloom.errors import HookFailed, InvalidInput
from codeloom.schema import Contract, validate

Hook = Callable[[DataFrame], DataFrame]

# The places where a hook can run.
PLACES = (
    "search_preprocess", "search_postprocess", "reverse_search_preprocess",
    "reverse_search_postprocess", "embed_preprocess", "embed_postprocess",
)


def check_hooks(hooks: dict[str, Hook] | None) -> dict[str, Hook]:
    if hooks is not None and not isinstance(hooks, dict):
        raise InvalidInput("hooks must be a dict or None")
    unknown = sorted(set(hooks or {}) - set(PLACES))
    if unknown:
        raise InvalidInput(f"unknown hooks {unknown}; there are {list(PLACES)}")
    return dict(hooks or {})


def chain(*hooks: Hook) -> Hook:
    """One hook that runs several in turn."""

    def run(df: DataFrame) -> DataFrame:
        for hook in hooks:
            df = hook(df)
        return df

    return run


def run_hook(hooks: dict[str, Hook], place: str, df: DataFrame, contract: Contract) -> DataFrame:
    """The hook's table, checked against the contract; ``df`` itself where no hook is set."""
    hook = hooks.get(place)
    if hook is None:
        return df
    try:
        return validate(hook(df), contract)
    except Exception as e:
        raise HookFailed(f"{place}: {type(e).__name__}: {e}") from e
