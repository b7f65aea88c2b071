"""Skills: named DataFrame functions, and injected model providers as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_skills: dict[str, tuple[Callable[..., DataFrame], str]] = {}


def skill(name: str, about: str = ""):
    """Registers a function of DataFrames under a name."""

    def add(f: Callable[..., DataFrame]):
        _skills[name] = (f, about)
        return f

    return add


def skills() -> dict[str, str]:
    return {name: about for name, (_, about) in sorted(_skills.items())}


def execute(name: str, *args, retries: int = 0, **options) -> DataFrame:
    """Runs a skill; a KeyError names the known ones."""
    if name not in _skills:
        raise KeyError(f"{name} is none of {', '.join(sorted(_skills))}")
    for left in range(retries, -1, -1):
        try:
            return _skills[name][0](*args, **options)
        except Exception:
            if not left:
                raise
    raise AssertionError


def provider(spark: SparkSession, name: str, f: Callable[[list[str]], list], returns: str = "string"):
    """Registers a batch model as a SQL function; a failing batch is tried text by text, a failing text gives null."""

    @F.pandas_udf(returns)
    def call(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        try:
            return pd.Series(f(rows))
        except Exception:  # noqa: BLE001 - one bad text must not lose the batch
            out = []
            for row in rows:
                try:
                    out.append(f([row])[0])
                except Exception:  # noqa: BLE001
                    out.append(None)
            return pd.Series(out)

    spark.udf.register(name, call)
    return call
