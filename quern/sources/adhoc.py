"""Read-only SQL over user tables, which a query knows as t1, t2, ...

The tables are bound as common table expressions around the query, so nothing of the caller's session is replaced. What a
query may read is judged on its analysed plan, where every name is resolved: each leaf lies under one of the bound views, or
is made of the query's own literals. No text of the query or of a plan is searched for names.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from quern.sources.readers import MAX_TABLES

#: Rows of a page.
PAGE_ROWS = 500
#: Functions that are refused by name, before anything is parsed; the plan is judged all the same.
_FUNCTIONS = re.compile(r"\b(reflect|java_method|try_reflect|input_file_name|read_files|parquet_scan|read_csv|read_json|read_parquet|glob)\s*\(", re.I)
#: Leaves that read nothing.
_OWN_LEAVES = {"OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"}
#: Expressions that call code of the session or of the JVM, or tell of files.
_REFUSED_EXPRESSIONS = {"CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDF", "ScalaUDAF", "ScalaAggregator", "InputFileName", "InputFileBlockStart", "InputFileBlockLength"}
_SKIPPED = r"'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/|`(?:[^`]|``)*`"
_LITERALS = re.compile(_SKIPPED + r"|\"[^\"]*\"", re.S)
_NAMES = re.compile(_SKIPPED + r"|\"([^\"]+)\"", re.S)


class RefusedSQL(ValueError):
    """The statement isn't a single query over the bound tables."""


@dataclass(frozen=True)
class Page:
    #: The rows of this page; all of them where there is no limit.
    rows: DataFrame
    limit: int | None
    offset: int
    fixes: tuple[str, ...] = ()
    _whole: DataFrame | None = field(default=None, repr=False)

    def has_more(self) -> bool:
        """Runs the query for the one row behind the page."""
        return self.limit is not None and not self._whole.offset(self.offset + self.limit).limit(1).isEmpty()


def admit(sql: str) -> str:
    """The statement without its last semicolon; raises RefusedSQL unless it is one query by its words.

    Words inside literals, quoted names and comments have no say.
    """
    bare = _LITERALS.sub(lambda m: " " if m.group(0)[:2] in ("--", "/*") else "''", sql).strip().rstrip(";").strip()
    if ";" in bare:
        raise RefusedSQL("one statement only")
    if not re.match(r"(with|select)\b", bare, re.I):
        raise RefusedSQL("a query starts with SELECT or WITH")
    if found := _FUNCTIONS.search(bare):
        raise RefusedSQL(f"{found.group(0).strip()} isn't allowed")
    return sql.strip().rstrip(";").rstrip()


def _all(seq) -> list:
    """A Scala sequence's elements."""
    return [seq.apply(i) for i in range(seq.size())]


def check_plan(spark: SparkSession, sql: str, bound: set[str]) -> None:
    """Analyses a statement, runs nothing, and raises RefusedSQL unless it is a query over the `bound` views alone.

    Before that the parsed tree is looked through for names in parts (another schema, or a path) and names that are made
    while the query is analysed, since to look those up would already touch what isn't bound.
    """
    jvm, state = spark._jvm, spark._jsparkSession.sessionState()
    is_a = lambda name: jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}")
    command, subquery = is_a("plans.logical.Command"), is_a("expressions.PlanExpression")

    def walk(plan, judge) -> None:
        """Judges every node of a plan and of the subqueries in its expressions; below a node only if `judge` says so."""
        plans = [plan]
        while plans:
            plan = plans.pop()
            if command.isInstance(plan):
                raise RefusedSQL(f"{plan.nodeName()} isn't a query")
            if not judge(plan):
                continue
            plans += _all(plan.children()) + [x for x in _all(plan.innerChildren()) if hasattr(x, "expressions")]
            expressions = _all(plan.expressions())
            while expressions:
                e = expressions.pop()
                if (called := e.getClass().getSimpleName()) in _REFUSED_EXPRESSIONS:
                    raise RefusedSQL(f"{called} isn't allowed")
                if subquery.isInstance(e):
                    plans.append(e.plan())
                expressions += _all(e.children())

    def plainly_named(plan) -> bool:
        kind = plan.nodeName()
        if kind == "UnresolvedRelation" and plan.multipartIdentifier().size() > 1 or "UnresolvedIdentifier" in kind:
            raise RefusedSQL("a table has a name of one part; there are t1, t2, ...")
        return True

    def of_bound_tables(plan) -> bool:
        kind = plan.nodeName()
        if kind == "View":
            if (name := plan.desc().identifier().table()) not in bound:
                raise RefusedSQL(f"no table {name}")
            return False  # what lies below is the caller's own table
        if not plan.children().size() and kind not in _OWN_LEAVES:
            raise RefusedSQL(f"{kind} isn't one of the tables")
        return True

    parsed = state.sqlParser().parsePlan(sql)
    walk(parsed, plainly_named)
    walk(state.executePlan(parsed, getattr(state, "executePlan$default$2")()).analyzed(), of_bound_tables)


def reconcile(sql: str, columns: list[str]) -> tuple[str, tuple[str, ...]]:
    """Names in double quotes that differ from a column only in case or blanks become that column, in back quotes.

    Literals, comments and names in back quotes stay as they are.
    """
    known = {re.sub(r"\s+", "", c).lower(): c for c in columns}
    fixes: list[str] = []

    def fixed(m: re.Match) -> str:
        name = m.group(1)
        column = name if name is None or name in columns else known.get(re.sub(r"\s+", "", name).lower())
        if column is None:
            return m.group(0)
        if column != name:
            fixes.append(f"{name} -> {column}")
        return f"`{column}`"

    return _NAMES.sub(fixed, sql), tuple(fixes)


def suggest(column: str, columns: list[str]) -> str | None:
    """The column that an unknown name probably means."""
    plain = {re.sub(r"[\s_]+", "", c).lower(): c for c in columns}
    asked = re.sub(r"[\s_]+", "", column).lower()
    return plain.get(asked) or next((c for p, c in sorted(plain.items()) if p.startswith(asked) or asked.startswith(p)), None)


def run_sql(spark: SparkSession, tables: list[DataFrame], sql: str, limit: int | None = PAGE_ROWS, offset: int = 0) -> Page:
    """One page of a query over `tables`, known as t1, t2, ...; without a limit all rows, in as many partitions as there are.

    The plan is lazy. Views of other names hold the tables until the plan is made.
    """
    if len(tables) > MAX_TABLES:
        raise RefusedSQL(f"at most {MAX_TABLES} tables")
    text, fixes = reconcile(admit(sql), [c for t in tables for c in t.columns])
    views = [f"bound_{uuid.uuid4().hex}" for _ in tables]
    try:
        for view, t in zip(views, tables):
            t.createTempView(view)
        bound = ", ".join(f"t{i} AS (SELECT * FROM {view})" for i, view in enumerate(views, 1))
        statement = f"WITH {bound} SELECT * FROM (\n{text}\n)" if bound else text
        check_plan(spark, statement, set(views))
        whole = spark.sql(statement)
    except ParseException as e:
        raise RefusedSQL(f"not understood: {str(e).splitlines()[0]}") from e
    except AnalysisException as e:
        if "TABLE_OR_VIEW_NOT_FOUND" in str(e):
            raise RefusedSQL(f"no such table; there are t1 to t{len(tables)}") from e
        if m := re.search(r"name `([^`]+)` cannot be resolved", str(e)):
            if guess := suggest(m.group(1), [c for t in tables for c in t.columns]):
                raise RefusedSQL(f"no column {m.group(1)}; did you mean {guess}?") from e
        raise
    finally:
        for view in views:
            spark.catalog.dropTempView(view)
    rows = whole.offset(offset) if offset else whole
    return Page(rows if limit is None else rows.limit(limit), limit, offset, fixes, whole)
