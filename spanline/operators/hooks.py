"""Places for user code: batch adapters, model calls with checked answers, per-recording solvers, row splitters and aggregates.

Adapters run in the tasks on Arrow batches; what they must give back is checked with joins, not by the adapter.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

ADAPTERS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = {}


def register_adapter(name: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> None:
    """A function from a batch of rows to rows of `schema`, which holds `id`."""
    ADAPTERS[name] = (function, schema)


def run_adapter(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(results, problems): each requested id must come back once; missing, repeated and unexpected ids are problems."""
    function, schema = ADAPTERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    got = rows.mapInPandas(run, schema)
    counts = rows.groupBy("id").agg(F.count("*").alias("asked")).join(got.groupBy("id").agg(F.count("*").alias("given")), "id", "full_outer").fillna(0)
    code = F.when(F.col("given") == 0, "MISSING").when(F.col("asked") == 0, "UNEXPECTED").when(F.col("given") > F.col("asked"), "REPEATED")
    return got, counts.select("id", code.alias("code")).where("code IS NOT NULL")


def call_provider(rows: DataFrame, provider: Callable[[str, int], str], attempts: int = 3) -> DataFrame:
    """(id, answer, attempt, valid): the first answer that is a JSON object, tried at most `attempts` times a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, prompt in zip(batch["id"], batch["prompt"], strict=True):
                for attempt in range(1, attempts + 1):
                    answer = provider(prompt, attempt)
                    try:
                        valid = isinstance(json.loads(answer), dict)
                    except ValueError:
                        valid = False
                    if valid:
                        break
                out.append((i, answer, attempt, valid))
            yield pd.DataFrame(out, columns=["id", "answer", "attempt", "valid"])

    return rows.select("id", "prompt").mapInPandas(run, "id long, answer string, attempt int, valid boolean")


def per_group(rows: DataFrame, keys: list[str], solver: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most_rows: int) -> DataFrame:
    """A solver for each group of at most `most_rows` rows; a larger group raises an error before any group is handed over."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most_rows).limit(1).collect()
    if large:
        raise ValueError(f"a group has {large[0]['n']} rows, more than {most_rows}")
    return rows.groupBy(*keys).applyInPandas(solver, schema)


def splitter(function: Callable[[str], list[str]]) -> UserDefinedTableFunction:
    """A user function from a text to pieces, as a table function for a lateral join."""

    class Split:
        def eval(self, text: str):
            for k, piece in enumerate(function(text)):
                yield k, piece

    return F.udtf(Split, returnType="place int, piece string")


def aggregate(function: Callable[[pd.Series], float]):
    """A user function from a column of a group to one number."""

    def run(values: pd.Series) -> float:
        return float(function(values))

    return F.pandas_udf(run, "double")
