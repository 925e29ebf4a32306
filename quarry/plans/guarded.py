"""Ad hoc SQL: read-only statements over named tables, with a row cap and safe column names."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Logical plans that read. A statement with any other kind of node, at any depth, is refused.
READING = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "LimitAll", "Offset", "Distinct", "Union", "Intersect", "Except", "Join", "LateralJoin", "Subquery", "SubqueryAlias",
    "UnresolvedWith", "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "OneRowRelation", "LocalRelation",
    "Generate", "Pivot", "Unpivot", "WithWindowDefinition", "Tail", "ExplainCommand", "Range", "Sample", "UnionLoop", "UnresolvedHint", "AsOfJoin",
}
#: Functions that run code of the host or read what isn't a table.
FORBIDDEN = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files"}
#: Table functions that make rows from their arguments alone.
ROW_MAKING = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}


class Refused(ValueError):
    """A statement that doesn't only read."""


def _items(seq) -> Iterator:  # noqa: ANN001
    """The elements of a Scala sequence."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:  # noqa: ANN001
    return node.getClass().getSimpleName().rstrip("$")


def _expressions(node) -> Iterator:  # noqa: ANN001
    rest = list(_items(node.expressions()))
    while rest:
        e = rest.pop()
        yield e
        rest += _items(e.children())


def _nodes(plan) -> Iterator:  # noqa: ANN001
    """All nodes of a parsed plan: children, common table expressions, what EXPLAIN would run, subqueries in expressions."""
    rest = [plan]
    while rest:
        node = rest.pop()
        yield node
        kind = _kind(node)
        if kind not in READING:
            continue  # it is refused as it is
        rest += _items(node.children())
        if kind == "UnresolvedWith":
            rest += [x._2() for x in _items(node.cteRelations())]
        if kind == "ExplainCommand":
            rest.append(node.logicalPlan())
        for e in _expressions(node):
            if _kind(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                rest.append(e.plan())


def _names(parts) -> list[str]:  # noqa: ANN001
    return [str(x).lower() for x in _items(parts)]


def checked(spark: SparkSession, sql: str, tables: Sequence[str]) -> None:
    """Raises ``Refused`` unless ``sql`` only reads ``tables`` and what it defines itself."""
    nodes = list(_nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)))
    known = {t.lower() for t in tables}
    for node in nodes:
        if _kind(node) == "UnresolvedWith":
            known |= {str(x._1()).lower() for x in _items(node.cteRelations())}
    for node in nodes:
        kind = _kind(node)
        if kind not in READING:
            raise Refused(f"only reading statements are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            name = _names(node.multipartIdentifier())
            if len(name) != 1 or name[0] not in known:
                raise Refused(f"no such table: {'.'.join(name)}")
        if kind == "UnresolvedTableValuedFunction" and (name := _names(node.name()))[-1] not in ROW_MAKING:
            raise Refused(f"the function {name[-1]} is not allowed")
        for e in _expressions(node):
            if _kind(e) == "UnresolvedFunction" and (name := _names(e.nameParts()))[-1] in FORBIDDEN:
                raise Refused(f"the function {name[-1]} is not allowed")


def distinct_names(names: Sequence[str]) -> list[str]:
    """Repeated names get __2, __3, ...."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}__{seen[n]}")
    return out


def read_only(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The rows of one reading statement over ``tables``, which are views for as long as it is analysed.

    The whole parsed plan is checked: a write, command or file at any depth is refused.
    """
    text, tables = sql.strip().rstrip(";"), tables or {}
    checked(spark, text, list(tables))
    made, hidden = [], {}
    try:
        for name, df in tables.items():
            if re.search(rf"\b{re.escape(name)}\b", text, re.IGNORECASE):
                if spark.catalog._jcatalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
                    hidden[name] = spark.table(name)
                df.createOrReplaceTempView(name)
                made.append(name)
        got = spark.sql(text)
    finally:
        for name in made:
            if name in hidden:
                hidden[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
    return got.toDF(*distinct_names(got.columns))
