"""Guarded SQL: only reads, only relations in scope, a row cap; checked on the parsed plan, not on the text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS, ATTEMPTS = 200, 3
_READS = {"Project", "Aggregate", "UnresolvedWith", "GlobalLimit", "LocalLimit", "Sort", "Distinct", "Filter", "Union", "Except", "Intersect", "Join", "UnresolvedHaving", "SubqueryAlias", "WithWindowDefinition", "UnresolvedInlineTable", "Offset", "Pivot", "Unpivot", "OneRowRelation", "UnresolvedSubqueryColumnAliases"}


class GuardError(ValueError):
    """The statement is not a read in scope."""


def _nodes(plan) -> list:
    """All nodes of a plan, those of its subqueries and of its named queries included."""
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        found.append(p)
        for kids in (p.children(), p.innerChildren(), p.subqueries()):
            it = kids.iterator()
            while it.hasNext():
                k = it.next()
                if "plans.logical" in k.getClass().getName() or "catalyst.analysis" in k.getClass().getName():
                    todo.append(k)
    return found


def check(spark: SparkSession, sql: str, allowed: Iterable[str]) -> bool:
    """Raise GuardError unless sql is one read over allowed relations; whether its root has a limit."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise GuardError(f"not one statement: {str(e)[:200]}") from None
    if plan.getClass().getSimpleName() not in _READS:
        raise GuardError(f"not a read: {plan.getClass().getSimpleName()}")
    scope, named = {a.lower() for a in allowed}, set()
    nodes = _nodes(plan)
    for p in nodes:
        if p.getClass().getSimpleName() == "UnresolvedWith":
            it = p.cteRelations().iterator()
            while it.hasNext():
                named.add(it.next()._1().lower())
    for p in nodes:
        kind = p.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            name = p.tableName().replace("`", "").lower()
            if name not in scope and name not in named:
                raise GuardError(f"out of scope: {name}")
        elif kind in ("UnresolvedTableValuedFunction", "ScriptTransformation"):
            raise GuardError(f"not allowed: {kind}")
    top = plan
    while top.getClass().getSimpleName() == "UnresolvedWith":
        top = top.child()
    return top.getClass().getSimpleName() == "GlobalLimit"


def run_sql(spark: SparkSession, sql: str, allowed: Iterable[str], max_rows: int = MAX_ROWS) -> DataFrame:
    return spark.sql(sql) if check(spark, sql, allowed) else spark.sql(sql).limit(max_rows)


def answer(spark: SparkSession, propose: Callable[[str | None], str], allowed: Iterable[str], attempts: int = ATTEMPTS) -> tuple[DataFrame | None, list[str]]:
    """Ask for SQL, run it, give errors back, at most `attempts` times; an empty proposal ends it."""
    errors: list[str] = []
    for _ in range(attempts):
        sql = propose(errors[-1] if errors else None)
        if not sql.strip():
            break
        try:
            df = run_sql(spark, sql, allowed)
            df.schema  # noqa: B018  analysis errors show here
            return df, errors
        except Exception as e:
            errors.append(str(e)[:500])
    return None, errors
