"""A read-only SQL facade over named tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 10_000
#: Functions that reach outside the tables.
BARRED = {"java_method", "reflect", "try_reflect", "read_files", "input_file_name"}


class NotASelect(ValueError):
    pass


def register(spark: SparkSession, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def is_query(spark: SparkSession, sql: str) -> bool:
    """True for a plan without commands; judged by the parsed plan, not by words in the text."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getName()
        if ".command." in name or "Command" in name or name.rsplit(".", 1)[-1].startswith(("Create", "Drop", "Insert", "Delete", "Update", "Merge", "Alter", "Truncate", "Set", "Cache", "Uncache", "Refresh", "Overwrite", "Append", "Replace")):
            return False
        if name.endswith(("UnresolvedRelation", "UnresolvedTableValuedFunction")) and not _known(spark, p):
            return False
        if not _plain(p):
            return False
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return True


def _known(spark: SparkSession, node) -> bool:
    """A relation is a temporary view or one of the plan's own names; paths such as parquet.`/a` have two parts. Table functions are refused but for range and explode."""
    if node.getClass().getName().endswith("UnresolvedTableValuedFunction"):
        return node.name().last().lower() in ("range", "explode", "posexplode", "inline", "stack")
    return node.multipartIdentifier().size() == 1


def _plain(node) -> bool:
    """No expression of the node, and no plan within one, uses a barred function or an unknown relation."""
    text = node.toString().lower()
    return not any(re.search(rf"'?\b{f}\s*\(", text) for f in BARRED) and not re.search(r"unresolvedrelation \[[^\]]*,", text)


def execute(spark: SparkSession, sql: str, limit: int = 100) -> DataFrame:
    """The rows of a single SELECT, at most ``limit`` of them (a feature of the facade)."""
    sql = sql.strip().rstrip(";")
    if not is_query(spark, sql):
        raise NotASelect("only queries are allowed")
    return spark.sql(sql).limit(min(limit, MAX_ROWS))


def report(spark: SparkSession, template: str, names: dict[str, str], **values) -> DataFrame:
    """A report query: {macros} become quoted identifiers, :parameters become literals."""
    sql = template.format(**{k: "`" + v.replace("`", "``") + "`" for k, v in names.items()})
    if not is_query(spark, sql):
        raise NotASelect("only queries are allowed")
    return spark.sql(sql, args=values)
