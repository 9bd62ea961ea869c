"""Saved queries: a small table of named SQL text, and running one of them without letting it do more than read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merging as G

SCHEMA = "id string, name string, sql string"
ID = r"^[0-9A-Za-z_-]{1,64}$"
#: What a parsed plan may consist of.
READING = {
    "Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedSubqueryColumnAliases",
    "UnresolvedRelation", "UnresolvedInlineTable", "OneRowRelation", "UnresolvedWith", "WithWindowDefinition", "Generate", "Pivot", "UnresolvedOrderBy", "Window", "LateralJoin", "Sample",
}
#: Functions that reach beyond the rows.
REFUSED = {"reflect", "java_method", "try_reflect"}


def put(saved: DataFrame, id_: str, name: str, sql: str) -> DataFrame:
    """saved with this query in place of one of the same id."""
    spark = saved.sparkSession
    rows = spark.createDataFrame([(id_, name, sql, 1)], f"{SCHEMA}, seq int").filter(F.col("id").rlike(ID))
    if rows.isEmpty():
        raise ValueError(f"{id_!r} is no id")
    return G.upsert(saved.withColumn("seq", F.lit(0)), rows, "id", "seq").drop("seq")


def post(saved: DataFrame, name: str, sql: str) -> tuple[DataFrame, str]:
    """saved with a new query, and the id it has been given."""
    id_ = uuid.uuid4().hex
    return put(saved, id_, name, sql), id_


def get(saved: DataFrame, id_: str) -> DataFrame:
    """The query of an id; no row if there is none."""
    return saved.filter(F.col("id") == id_)


def delete(saved: DataFrame, id_: str) -> tuple[DataFrame, bool]:
    """saved without an id, and whether it was there."""
    return saved.filter(~F.col("id").eqNullSafe(id_)), not get(saved, id_).isEmpty()


def _nodes(plan):
    """The plan's nodes, those of common table expressions and of subqueries included."""
    yield plan
    for group in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for i in range(group.size()):
            yield from _nodes(group.apply(i))


def check(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Raises ValueError unless the parsed text is one query over these tables (and its own common tables) alone."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise ValueError("no query") from error
    names, asked = set(tables), set()
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind not in READING:
            raise ValueError(f"{kind} isn't allowed")
        if kind == "UnresolvedWith":
            names |= {node.cteRelations().apply(i)._1() for i in range(node.cteRelations().size())}
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            asked.add(parts.apply(0) if parts.size() == 1 else parts.mkString("."))
        words = {w.strip("`( ").lower() for w in node.expressions().mkString(" ").replace("(", "( ").replace("'", " ").split()}
        if words & REFUSED:
            raise ValueError(f"{sorted(words & REFUSED)} isn't allowed")
    if asked - names:
        raise ValueError(f"no such tables: {sorted(asked - names)}")


def run(saved: DataFrame, name: str, **tables: DataFrame) -> DataFrame:
    """The rows of a saved query, found by its name (of several the one of the greatest id); ``{table}`` in its text stands for a given table."""
    spark = saved.sparkSession
    text = saved.filter(F.col("name") == name).agg(F.max_by("sql", "id")).first()[0]
    if text is None:
        raise ValueError(f"{name} isn't saved")
    check(spark, text.format(**{t: t for t in tables}), set(tables))
    return spark.sql(text, **tables)
