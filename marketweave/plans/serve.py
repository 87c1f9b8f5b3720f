"""Guarded SQL over the gold relations, question templates and markdown results."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from marketweave.errors import PermanentError

GOLD = ("mart_features", "mart_feature_summary", "mart_stock_screener")
ROWS = 200
TIMEOUT_S = 60.0

#: Plan nodes that a single SELECT is made of; anything else (commands, files, table functions) is refused.
_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias", "UnresolvedRelation", "Join", "Distinct", "Union", "UnresolvedWith", "UnresolvedHaving",
    "OneRowRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "Except", "Intersect", "WithWindowDefinition", "UnresolvedOrderBy",
}
_CALLS_REFUSED = {"reflect", "java_method", "try_reflect", "input_file_name", "raise_error"}


def _items(seq) -> Iterable:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def guard(spark: SparkSession, sql: str, gold: Iterable[str] = GOLD) -> None:
    """Raise unless the text is one SELECT on gold relations; judged on the parsed plan, not on the text."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise PermanentError(f"not a single SQL statement: {str(error).splitlines()[0]}") from error
    allowed = {g.lower() for g in gold}

    def expression(e, names: set[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            walk(e.plan(), names)
        if kind == "UnresolvedFunction" and ".".join(_items(e.nameParts())).lower() in _CALLS_REFUSED:
            raise PermanentError("this function is not allowed")
        for child in _items(e.children()):
            expression(child, names)

    def walk(node, names: set[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in _NODES:
            raise PermanentError(f"only SELECT on the gold relations is allowed, not {kind}")
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                walk(pair._2(), names)
                names = names | {pair._1().lower()}
        if kind == "UnresolvedRelation":
            name = ".".join(_items(node.multipartIdentifier())).lower()
            if name not in allowed and name not in names:
                raise PermanentError(f"{name} is not a gold relation")
        for e in _items(node.expressions()):
            expression(e, names)
        for child in _items(node.children()):
            walk(child, names)

    walk(plan, set())


def run_guarded(spark: SparkSession, sql: str, gold: Iterable[str] = GOLD, rows: int = ROWS) -> DataFrame:
    guard(spark, sql, gold)
    return spark.sql(sql).limit(rows)


def markdown(df: DataFrame, timeout: float = TIMEOUT_S) -> str:
    """The (bounded) result as a markdown table; the job is cancelled after the timeout."""
    sc, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    timer = threading.Timer(timeout, sc.cancelJobGroup, [group])
    sc.setJobGroup(group, "serving query", interruptOnCancel=True)
    timer.start()
    try:
        found = df.collect()
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    text = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", r"\|")
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in found])


_NUMBER = r"(\d+(?:\.\d+)?)"
_UNITS = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}


def template_sql(question: str) -> str | None:
    """SQL of the question shapes the engine knows; None for others. No free text reaches the SQL."""
    q, where, order = question.lower(), [], "ticker"
    first = lambda pattern: next(iter(re.findall(pattern, q)), None)
    if n := first(rf"p/?e (?:ratio )?(?:under|below|<|less than)\s*{_NUMBER}"):
        where.append(f"price_to_earnings < {n}")
    if n := first(rf"growth (?:above|over|>|more than)\s*{_NUMBER}\s*%"):
        where.append(f"revenue_growth_qoq > {float(n) / 100!r}")
    if n := first(rf"margin (?:above|over|>|more than)\s*{_NUMBER}\s*%"):
        where.append(f"net_margin > {float(n) / 100!r}")
    if n := first(rf"(?:under|below|<)\s*\$\s*{_NUMBER}\s*([kmbt])"):
        where.append(f"market_cap < {float(n[0]) * _UNITS[n[1]]!r}")
    if "profitable" in q:
        where.append("net_income > 0")
    if "negative cash flow" in q:
        where.append("operating_cash_flow < 0")
    if n := first(rf"debt[- ]to[- ]market[- ]cap (?:above|over|>)\s*{_NUMBER}"):
        where.append(f"debt_to_market_cap > {n}")
    if "highest sharpe" in q:
        where.append("sharpe_30d IS NOT NULL")
        order = "sharpe_30d DESC, ticker"
    if not where:
        return None
    return f"SELECT * FROM mart_stock_screener WHERE {' AND '.join(where)} ORDER BY {order} LIMIT 50"


def screen_stocks(spark: SparkSession, question: str, to_sql: Callable[[str], str] | None = None) -> str:
    """Markdown answer: a given language model's SQL or a template's, always behind the guard."""
    sql = to_sql(question) if to_sql else template_sql(question)
    if not sql:
        raise PermanentError("no template fits the question")
    return markdown(run_guarded(spark, sql))


def fundamentals_of(spark: SparkSession, ticker: str) -> DataFrame:
    """One ticker's screener row; the ticker is a parameter, never part of the text."""
    return spark.sql("SELECT * FROM mart_stock_screener WHERE ticker = :ticker", args={"ticker": ticker})


def compare(spark: SparkSession, tickers: list[str]) -> DataFrame:
    return spark.sql("SELECT * FROM mart_stock_screener WHERE array_contains(:tickers, ticker)", args={"tickers": tickers})


def sector(spark: SparkSession, name: str | None = None) -> DataFrame:
    return spark.sql(
        "SELECT sector, count(*) AS tickers, avg(price_to_earnings) AS avg_pe, avg(net_margin) AS avg_margin FROM mart_stock_screener WHERE :name IS NULL OR sector = :name GROUP BY sector", args={"name": name}
    )
