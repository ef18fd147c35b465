"""A loop of stages in which a row that fails goes to the dead letters and the others go on.

Rows carry their error in a column. A stage gets rows that have none, at most as many as its budget (those that waited
longest first), and gives them back with an error where it failed. What a budget leaves over is for the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.session import stored
from trustmill.sources.sinks import dead_letters

ERROR = "_error"
#: Signs of an error that are kept.
ERROR_SIGNS = 300


@dataclass(frozen=True)
class Stage:
    name: str
    #: Rows with the column ERROR, null where all went well.
    apply: Callable[[DataFrame], DataFrame]
    budget: int | None = None
    #: The rows that are taken first when there are more than the budget.
    order: tuple[Column, ...] = ()


def by_columns(values: dict[str, Column], error: Column) -> Callable[[DataFrame], DataFrame]:
    """A stage of column expressions; error says what is wrong with a row, null if nothing."""
    return lambda rows: rows.withColumns({**values, ERROR: F.left(error, F.lit(ERROR_SIGNS))})


def by_row(step: Callable[[dict], dict], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A stage that calls step(row) -> new values (schema) in tasks, for what only Python can do; an exception is that
    row's error and leaves the new values null."""
    names = [c.split()[0] for c in schema.split(",")]

    def apply(rows: DataFrame) -> DataFrame:
        kept = [f for f in rows.schema.fields if f.name not in (*names, ERROR)]
        out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema, f"{ERROR} string"])

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in it:
                made, errors = [], []
                for row in batch.to_dict("records"):
                    try:
                        made.append(step(row))
                        errors.append(None)
                    except Exception as e:  # the row's failure is its result
                        made.append(dict.fromkeys(names))
                        errors.append(f"{type(e).__name__}: {e}"[:ERROR_SIGNS])
                values = pd.DataFrame(made, columns=names, index=batch.index)
                yield pd.concat([batch[[f.name for f in kept]], values], axis=1).assign(**{ERROR: errors})

        return rows.mapInPandas(run, out)

    return apply


def _taken(rows: DataFrame, stage: Stage, key: list[str]) -> tuple[DataFrame, DataFrame]:
    if stage.budget is None:
        return rows, rows.limit(0)
    taken = rows.orderBy(*stage.order, *key).limit(stage.budget)
    return taken, rows.join(taken.select(*key), key, "left_anti")


def run(rows: DataFrame, stages: list[Stage], key: list[str]) -> dict[str, DataFrame]:
    """done, left, dead_letters and report after all stages. key: columns that tell the rows apart.

    report: stage, taken, ok, failed, left. Each stage's rows are written to the shared folder, so that a lost executor
    repeats one stage, and a stage that acts outside is not repeated by a later one.
    """
    todo, left, dead, told = rows, [], [], []
    for number, stage in enumerate(stages):
        taken, rest = _taken(todo, stage, key)
        out = stored(stage.apply(taken), f"stage-{number}")
        bad = F.col(ERROR).isNotNull()
        failed = out.where(bad)
        left.append(rest.select(*key).withColumn("stage", F.lit(stage.name)))
        dead.append(dead_letters(failed.select(*key, F.col(ERROR)), stage.name, F.col(ERROR)))
        one, none = F.lit(1), F.lit(0)
        counted = out.select(one.alias("taken"), (~bad).cast("int").alias("ok"), bad.cast("int").alias("failed"), none.alias("left")).unionByName(rest.select(none.alias("taken"), none.alias("ok"), none.alias("failed"), one.alias("left")))
        told.append(counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("taken", "ok", "failed", "left"))).select(F.lit(number).alias("number"), F.lit(stage.name).alias("stage"), "*"))
        todo = out.where(~bad).drop(ERROR)

    def together(frames: list[DataFrame]) -> DataFrame:
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f)
        return whole

    return {"done": todo, "left": together(left), "dead_letters": together(dead), "report": together(told)}


def report_map(report: DataFrame) -> DataFrame:
    """One row: a map from the stage's name to its counts."""
    entry = F.struct("stage", F.struct("taken", "ok", "failed", "left"))
    return report.agg(F.map_from_entries(F.collect_list(entry)).alias("stages"))
