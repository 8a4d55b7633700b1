"""Cleaning rules: an ordered list that either filters a table or accounts for its losses."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mercato.operators.keys import anti_filter, arrival_columns, keep_first, semi_filter


@dataclass(frozen=True)
class Keep:
    """Rows pass if the predicate is true."""

    name: str
    predicate: Column


@dataclass(frozen=True)
class HasParent:
    """Rows pass if the column holds a key of the parent table."""

    name: str
    column: str
    parents: DataFrame
    parent_column: str


@dataclass(frozen=True)
class FirstOf:
    """Only the first row of each key passes."""

    name: str
    keys: tuple[str, ...]


Rule = Keep | HasParent | FirstOf

#: Column of a raw table that marks the rows its source could not parse.
UNREADABLE = "_unreadable"


def readable(df: DataFrame) -> list[Rule]:
    """The rule against rows that could not be parsed, if the source marks them."""
    return [Keep("unreadable row", ~F.col(UNREADABLE))] if UNREADABLE in df.columns else []


class Losses:
    """Counts the rows left after each rule while a table is written, without reading it again.

    Spark counts in the tasks that do the work. A task that ran twice because an executor was lost may count twice;
    ``count_rejects`` then gives the exact figures.
    """

    def __init__(self, table: str):
        self.table = table
        self.seen: list[tuple[str, Observation]] = []

    def after(self, rule: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self.seen.append((rule, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[str, int, str, int, int]] | None:
        """(table_name, step, rule, rows_left, rows_dropped), once the table has been written.

        None where Spark has found a part of the plan empty beforehand and left its counts out.
        """
        out: list[tuple[str, int, str, int, int]] = []
        for step, (rule, seen) in enumerate(self.seen):
            try:
                left = seen.get["rows"]
            except (KeyError, Py4JJavaError):
                return None
            out.append((self.table, step, rule, left, out[-1][3] - left if out else 0))
        return out


def required(*columns: str) -> Keep:
    return Keep("missing " + ", ".join(columns), reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def _is_shuffled_for(rule: Rule) -> bool:
    """Whether Spark shuffles rows to look for their parents, by its size check."""
    if not isinstance(rule, HasParent):
        return False
    keys = rule.parents.select(rule.parent_column)._jdf.queryExecution()
    return keys.optimizedPlan().stats().sizeInBytes() > keys.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()


def apply_rules(
    df: DataFrame,
    rules: Sequence[Rule],
    losses: Losses | None = None,
    staged: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows that pass all rules.

    ``staged`` writes rows and reads them back. It is called wherever rows that were shuffled once have to be
    shuffled anew for their parents, so that the disk holds one shuffle at a time.
    """
    shuffled = False
    for n, rule in enumerate(rules):
        if staged and shuffled and _is_shuffled_for(rule):
            if not any(isinstance(later, FirstOf) for later in rules[n:]):
                df = df.drop(*arrival_columns(df), UNREADABLE)
            df = staged(df)
        shuffled = shuffled or isinstance(rule, FirstOf) or _is_shuffled_for(rule)
        if isinstance(rule, Keep):
            df = df.where(rule.predicate)
        elif isinstance(rule, HasParent):
            df = semi_filter(df, rule.column, rule.parents, rule.parent_column)
        else:
            df = keep_first(df, rule.keys)
        if losses:
            df = losses.after(rule.name, df)
    return df


def waiting_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """Rows that pass every rule up to one that asks for a parent, and have none yet."""
    out: list[DataFrame] = []
    for n, rule in enumerate(rules):
        if isinstance(rule, HasParent):
            keys = rule.parents.select(F.col(rule.parent_column).alias(rule.column))
            out.append(anti_filter(apply_rules(df, rules[:n]), [rule.column], keys))
    return reduce(DataFrame.unionByName, out) if out else None


def count_rejects(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """Rows left and rows dropped after each rule: (table_name, step, rule, rows_left, rows_dropped).

    The table is read once. A row carries a mark for each rule that it has passed. At a ``FirstOf`` rule the rows of
    a key become one, with the sums of their marks and the first row that is still alive, which partial aggregation
    finds before the shuffle; so a key with many copies costs one row a task here too.
    """
    columns, order, alive = df.columns, arrival_columns(df), F.col("_alive")
    if not order and any(isinstance(rule, FirstOf) for rule in rules):
        raise ValueError("no order: which row comes first would be left to chance")
    df = df.withColumns({"_alive": F.lit(True), "_left_0": F.lit(1).cast("bigint")})
    for n, rule in enumerate(rules, 1):
        if isinstance(rule, Keep):
            df = df.withColumn("_alive", alive & F.coalesce(rule.predicate, F.lit(False)))
        elif isinstance(rule, HasParent):
            parents = rule.parents.select(F.col(rule.parent_column).alias("_parent"))
            known = df.join(parents, alive & (F.col(rule.column) == F.col("_parent")), "left")
            df = known.withColumn("_alive", F.col("_parent").isNotNull()).drop("_parent")
        else:
            keys = [F.col(key).alias(f"_key_{m}") for m, key in enumerate(rule.keys)]
            marks = [f"_left_{m}" for m in range(n)]
            first = F.min_by(F.struct(*columns), F.when(alive, F.struct(*order))).alias("_row")
            df = df.groupBy(*keys).agg(first, *[F.sum(mark).alias(mark) for mark in marks])
            df = df.select("_row.*", *marks, F.col("_row").isNotNull().alias("_alive"))
        df = df.withColumn(f"_left_{n}", alive.cast("bigint"))
    names = ["input", *[rule.name for rule in rules]]
    counts = [
        F.struct(
            F.lit(n).alias("step"), F.lit(name).alias("rule"), F.coalesce(F.sum(f"_left_{n}"), F.lit(0)).alias("rows_left")
        )
        for n, name in enumerate(names)
    ]
    # One row per step from here on: a handful per table.
    steps = df.agg(F.array(*counts).alias("steps")).select(F.explode("steps").alias("s")).select("s.*")
    before = F.lag("rows_left", 1).over(Window.orderBy("step"))
    return steps.select(
        F.lit(table).alias("table_name"),
        "step",
        "rule",
        "rows_left",
        F.coalesce(before - F.col("rows_left"), F.lit(0)).alias("rows_dropped"),
    )
