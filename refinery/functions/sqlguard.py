"""Query routing (natural language vs SQL) and the read-only guard.

For logs there are Column expressions (first word only). Before a text is run,
``require_read_only`` looks at Spark's own parse of it.
"""

from __future__ import annotations

import json
import re
from functools import cache

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values (must match the reference): a query whose first word (lower-cased)
# is one of these is SQL; anything else is natural language.
SQL_KEYWORDS = ("select", "insert", "update", "delete", "create", "drop", "alter", "with")

# Statements refused by the read-only guard (first word, upper-cased).
FORBIDDEN = ("DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "GRANT", "REVOKE")

_FIRST_WORD_RE = r"(?U)^[\s\x{1c}-\x{1f}]*([^\s\x{1c}-\x{1f}]+)"


def first_word(q: Column) -> Column:
    """First whitespace-separated token ('' for blank text)."""
    return F.regexp_extract(q, _FIRST_WORD_RE, 1)


def is_natural_language_col(q: Column) -> Column:
    return ~F.lower(first_word(q)).isin(*SQL_KEYWORDS)


def forbidden_word_col(q: Column) -> Column:
    """The forbidden statement keyword a query starts with, else null."""
    w = F.upper(first_word(q))
    return F.when(w.isin(*FORBIDDEN), w)


_STARTS_SQL = re.compile(rf"\s*(?:{'|'.join(SQL_KEYWORDS)})(?!\S)", re.IGNORECASE)


def is_natural_language(query: str) -> bool:
    return _STARTS_SQL.match(query) is None


# Commands that only look (names of Spark's plan nodes).
_LOOKING = ("ExplainCommand", "ShowTables", "ShowColumns", "ShowNamespaces", "ShowFunctions", "ShowTablesCommand",
            "ShowColumnsCommand", "DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "DescribeTableCommand")

# Nodes that are no commands to Spark, but write, start programs or run a text.
_ACTING = ("Insert", "ScriptTransformation", "UnresolvedExecuteImmediate", "ExecuteImmediate")

# Built-in functions that call any method of the JVM.
_CALLING = frozenset(("reflect", "java_method", "try_reflect"))


class NotReadOnly(ValueError):
    """The text would change something, run code, or read past the catalogue."""


def parsed(spark: SparkSession, sql: str) -> JavaObject:
    """Spark's plan of ``sql`` before analysis; nothing is executed."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _nodes(value):
    """Every plan node and expression in a plan's JSON, wherever it is nested (subqueries,
    bodies of WITH)."""
    if isinstance(value, dict):
        if "num-children" in value:
            yield value
        value = value.values()
    elif not isinstance(value, list):
        return
    for part in value:
        yield from _nodes(part)


@cache
def _commanding(class_name: str) -> bool:
    """Is a node of this class a command or a statement?"""
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    load = jvm.org.apache.spark.util.Utils.classForName
    node = load(class_name, True, False)
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    return any(load(logical + kind, True, False).isAssignableFrom(node) for kind in ("Command", "ParsedStatement"))


@cache
def _built_in() -> frozenset[str]:
    """Names of Spark's own functions, table functions included."""
    from pyspark import SparkContext

    analysis = SparkContext._active_spark_context._jvm.org.apache.spark.sql.catalyst.analysis
    return frozenset(name for registry in (analysis.FunctionRegistry, analysis.TableFunctionRegistry)
                     for name in registry.functionSet().mkString("\n").split("\n"))


def _parts(identifier) -> list[str]:
    """The parts of a name as the plan's JSON renders them: ``[a, b]``."""
    if isinstance(identifier, dict):  # a function's identifier
        return [str(v) for k, v in identifier.items() if k in ("catalog", "database", "funcName") and v]
    return str(identifier).removeprefix("[").removesuffix("]").split(", ")


def _catalogued(spark: SparkSession, parts: list[str]) -> bool:
    """Names of one part are views, tables or WITH names. Longer ones may be a format and a
    path, so they have to be in the catalogue."""
    if len(parts) == 1:
        return True
    quoted = ["`" + part.replace("`", "``") + "`" for part in parts]
    whole = "`" + ", ".join(parts).replace("`", "``") + "`"
    return any(spark.catalog.tableExists(name) for name in (".".join(quoted), whole))


def require_read_only(spark: SparkSession, sql: str) -> JavaObject:
    """The parsed plan of ``sql``; NotReadOnly if anything in it, wherever it stands (behind
    comments, in a WITH, in a subquery, as CREATE TABLE AS SELECT, in a script), is

    * a command or a statement that writes, starts a program or runs a text;
    * a function that is not Spark's own, or calls methods of the JVM;
    * a relation that the catalogue does not know (a path: ``text.`/etc/hosts` ``).

    Nothing is analysed or opened before, not even a folder listed. Statements that only
    look (EXPLAIN, SHOW, DESCRIBE) pass: what they look at is not run.
    """
    plan = parsed(spark, sql)
    for at, node in enumerate(_nodes(json.loads(plan.toJSON()))):
        name = node["class"].rsplit(".", 1)[1]
        if at == 0 and name in _LOOKING:
            break
        if name.startswith(_ACTING) or _commanding(node["class"]):
            raise NotReadOnly(f"only reading queries may run here; the text holds {name}")
        if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            called = _parts(node.get("nameParts") or node.get("name"))[-1].lower()
            if called in _CALLING or called not in _built_in():
                raise NotReadOnly(f"the function {called} may not be called here")
        if name == "UnresolvedRelation" and not _catalogued(spark, _parts(node["multipartIdentifier"])):
            raise NotReadOnly(f"no table of the catalogue: {node['multipartIdentifier']}")
    return plan


def has_limit(plan: JavaObject) -> bool:
    """Does the query itself say how many rows it wants?"""
    while plan.getClass().getSimpleName() in ("UnresolvedWith", "WithCTE", "SubqueryAlias"):
        plan = plan.child()
    return plan.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit")
