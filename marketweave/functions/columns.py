"""Column functions of the domain; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted base forms, concept names, risk-free rate and year length.
BASE_FORMS = ("10-K", "10-Q", "8-K")
EPS = "EarningsPerShareBasic"
NET_INCOME = "NetIncomeLoss"
REVENUE = "Revenues"
REVENUE_FALLBACK = "RevenueFromContractWithCustomerExcludingAssessedTax"
DEBT = "LongTermDebt"
SHARES = "EntityCommonStockSharesOutstanding"
CASH_FLOW = "OperatingCashFlow"
CASH_FLOW_CONCEPT = "NetCashProvidedByUsedInOperatingActivities"
METRICS = (EPS, NET_INCOME, REVENUE, DEBT, SHARES, CASH_FLOW, REVENUE_FALLBACK)
CONCEPTS = {CASH_FLOW_CONCEPT: CASH_FLOW}
NAMESPACES = {SHARES: "dei"}
DEFAULT_NAMESPACE = "us-gaap"
RISK_FREE = 0.045
TRADING_DAYS = 252
MARKET_KEY = "_MARKET_"
ARCHIVE_ROOT = "https://www.sec.gov/"


def pad_cik(cik: Column) -> Column:
    """Left-padded with zeros to ten digits; longer text stays whole (lpad alone would cut it)."""
    text = F.trim(cik.cast("string"))
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def prefixed_cik(cik: Column) -> Column:
    return F.concat(F.lit("CIK"), pad_cik(cik))


def base_form(form: Column) -> Column:
    """The form without its amendment mark."""
    return F.substring_index(F.trim(form), "/", 1)


def accepted_form(form: Column) -> Column:
    """Accepted forms and their amendments."""
    return base_form(form).isin(*BASE_FORMS)


def filing_url(filename: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_ROOT), F.trim(filename))


def quarter_of(day: Column) -> Column:
    return F.quarter(day)


def index_url(day: Column) -> Column:
    """Address of a day's filing index."""
    return F.concat(
        F.lit(ARCHIVE_ROOT + "Archives/edgar/daily-index/"), F.year(day).cast("string"), F.lit("/QTR"), quarter_of(day).cast("string"), F.lit("/master."), F.date_format(day, "yyyyMMdd"), F.lit(".idx")
    )


def safe_upper(today: Column) -> Column:
    """The last day whose index is surely there: the day before yesterday."""
    return F.date_sub(today, 2)


def is_business_day(day: Column) -> Column:
    return ~F.dayofweek(day).isin(1, 7)


def metric_of(concept: Column) -> Column:
    """The metric label of a concept; most concepts are their own label."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, label in CONCEPTS.items():
        out = out.when(concept == name, label)
    return out.otherwise(concept)


def right_namespace(namespace: Column, concept: Column) -> Column:
    want = F.lit(DEFAULT_NAMESPACE)
    for name, ns in NAMESPACES.items():
        want = F.when(concept == name, ns).otherwise(want)
    return namespace == want


def valid_user_agent(agent: str | None) -> bool:
    """An honest agent names a mail address and is no placeholder."""
    return bool(agent) and "@" in agent and not any(x in agent.lower() for x in ("example.com", "your@", "you@", "<", "placeholder"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def risk_free_daily() -> Column:
    """A double division: the bare literal would be a narrow decimal."""
    return F.lit(RISK_FREE).cast("double") / F.lit(TRADING_DAYS)
