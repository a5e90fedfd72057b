"""What a SELECT from outside may do, decided on the plan that Spark's own parser makes of it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import SparkSession

# Plan nodes of a query.  Anything else (commands, writes, scripts, streams, names
# put together at run time) is refused.
PLANS = frozenset(
    """Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit
    Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Repartition RepartitionByExpression Sample
    Sort SubqueryAlias Transpose Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Unpivot Window
    WithWindowDefinition""".split()
)
TABLE_FUNCTIONS = frozenset("explode explode_outer inline inline_outer posexplode posexplode_outer range stack".split())
# Built-in functions that reach beyond the rows of a query.
REFUSED = frozenset(
    """current_catalog current_database current_schema current_user input_file_block_length input_file_block_start
    input_file_name java_method reflect session_user try_reflect user version""".split()
)
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
_TREE = "org.apache.spark.sql.catalyst.trees.TreeNode"


class Refused(ValueError):
    """The text asks for something that a guarded query may not do."""


def _nodes(spark: SparkSession, node: JavaObject) -> Iterator[JavaObject]:
    """All nodes of a parsed plan, those inside expressions and subqueries included."""
    gateway = spark.sparkContext._gateway
    waiting = [node]
    while waiting:
        item = waiting.pop()
        if not isinstance(item, JavaObject):
            continue
        if is_instance_of(gateway, item, _TREE):
            yield item
            waiting += [item.productElement(i) for i in range(item.productArity())]
        elif is_instance_of(gateway, item, "scala.collection.Iterable"):
            inner = item.iterator()
            while inner.hasNext():
                waiting.append(inner.next())
        elif is_instance_of(gateway, item, "scala.Product"):  # options and pairs
            waiting += [item.productElement(i) for i in range(item.productArity())]


def _texts(parts: JavaObject) -> list[str]:
    return [parts.apply(i) for i in range(parts.size())]


def check(spark: SparkSession, sql: str, tables: Iterable[str] | None = None, functions: Iterable[str] = ()) -> None:
    """Raise ``Refused`` unless ``sql`` is one query over allowed relations by allowed functions.

    Relations are the session's views and catalog tables, or only those named in ``tables``;
    files named by their path are none.  Functions are Spark's own without those that reach
    outside the rows, plus ``functions``.
    """
    if "${" in sql:
        raise Refused("settings and variables are not put into a query")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    gateway, builtin = spark.sparkContext._gateway, spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    allowed = None if tables is None else {t.lower() for t in tables}
    extra = {f.lower() for f in functions}
    nodes = list(_nodes(spark, plan))
    named = [(n, n.getClass().getSimpleName()) for n in nodes]
    ctes = {pair.lower() for n, kind in named if kind == "UnresolvedWith" for pair in _cte_names(n)}
    for node, kind in named:
        if is_instance_of(gateway, node, _LOGICAL) and kind.rstrip("$") not in PLANS:
            raise Refused(f"only SELECT queries are allowed, not {kind}")
        if "UnresolvedIdentifier" in kind:
            raise Refused("names must be written out")
        if kind == "UnresolvedRelation":
            _check_relation(spark, _texts(node.multipartIdentifier()), ctes, allowed)
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(_texts(node.name())).lower()
            if name not in TABLE_FUNCTIONS | extra:
                raise Refused(f"table function {name} is not allowed")
        elif kind == "UnresolvedFunction":
            name = ".".join(_texts(node.nameParts())).lower()
            if name not in extra and (name in REFUSED or not builtin.functionExists(identifier(name))):
                raise Refused(f"function {name} is not allowed")


def _cte_names(node: JavaObject) -> list[str]:
    pairs = node.cteRelations()
    return [pairs.apply(i).productElement(0) for i in range(pairs.size())]


def _check_relation(spark: SparkSession, parts: list[str], ctes: set[str], allowed: set[str] | None) -> None:
    name = ".".join(parts)
    if len(parts) == 1 and name.lower() in ctes:
        return
    if allowed is not None:
        if name.lower() not in allowed:
            raise Refused(f"table {name} is not allowed")
        return
    quoted = ".".join("`" + p.replace("`", "``") + "`" for p in parts)
    if not spark.catalog.tableExists(quoted):
        raise Refused(f"no table or view named {name}")
