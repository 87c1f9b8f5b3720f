"""Filing sources: daily index text, facts documents, filing histories, filing text."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions import columns as C
from marketweave.schemas import FILING_INDEX

_LINE = "cik STRING, company_name STRING, form_type STRING, date_filed STRING, filename STRING"

FACT = "end: DATE, val: DOUBLE, filed: DATE, form: STRING, accn: STRING, start: DATE"
FACTS_DOCUMENT = f"cik BIGINT, facts MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<{FACT}>>>>>>"


def parse_index(lines: DataFrame, amendments: bool = True, line: str = "value") -> DataFrame:
    """Index rows of text lines: pipe-separated fields after the header, forms filtered.

    Lines without a pipe and the header line drop out; the CIK is padded and the address
    completed. An empty input gives an empty result of the same columns.
    """
    data = lines.where(F.col(line).contains("|") & ~F.col(line).startswith("CIK"))
    # keep quote marks as text: names may hold them
    fields = F.from_csv(F.col(line), F.lit(_LINE), {"sep": "|", "quote": "\u0000", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    row = data.select(fields.alias("f")).select("f.*")
    form = F.trim("form_type")
    kept = C.accepted_form(form) if amendments else form.isin(*C.BASE_FORMS)
    return row.where(kept).select(
        C.pad_cik(F.col("cik")).alias("cik"),
        F.trim("company_name").alias("company_name"),
        form.alias("form_type"),
        F.try_to_date(F.trim("date_filed"), "yyyyMMdd").alias("date_filed"),
        F.trim("filename").alias("filename"),
        C.filing_url(F.col("filename")).alias("full_url"),
    )


def index_days(spark: SparkSession, since: date, until: date) -> DataFrame:
    """Rows (day, url) from since to until, both included; weekends have no file and drop out."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(since), F.lit(until))).alias("day")) if since <= until else spark.createDataFrame([], "day DATE")
    return days.where(C.is_business_day(F.col("day"))).select("day", C.index_url(F.col("day")).alias("url"))


def read_index_files(spark: SparkSession, folder: str, since: date, until: date, amendments: bool = True) -> DataFrame:
    """Index rows of the days' files in a folder (master.yyyyMMdd.idx); a day without a file is empty."""
    from marketweave.sources.files import existing

    names = [f"{folder.rstrip('/')}/master.{since + timedelta(k):%Y%m%d}.idx" for k in range(max(0, (until - since).days + 1))]
    found = existing(spark, names)
    if not found:
        return spark.createDataFrame([], FILING_INDEX.fields)
    return parse_index(spark.read.text(found), amendments)


def new_filers(index: DataFrame, universe: DataFrame | None, since: date, until: date) -> DataFrame:
    """Index rows of universe companies filed from since to until; without a universe, of all."""
    rows = index.where(F.col("date_filed").between(F.lit(since), F.lit(until)))
    return rows if universe is None else rows.join(universe.select(C.pad_cik(F.col("cik")).alias("cik")).distinct(), "cik", "left_semi").select(index.columns)


def unique_filers(index: DataFrame) -> DataFrame:
    return index.select("cik").distinct()


def parse_facts(documents: DataFrame, document: str = "value") -> DataFrame:
    """Fact rows (cik, namespace, concept, unit, value, dates, form, accession) of nested JSON documents.

    A document that isn't JSON gives no rows.
    """
    parsed = documents.select(F.from_json(F.col(document), F.lit(FACTS_DOCUMENT)).alias("d"))
    spaces = parsed.select(F.col("d.cik").alias("cik"), F.explode("d.facts").alias("namespace", "concepts"))
    concepts = spaces.select("cik", "namespace", F.explode("concepts").alias("concept", "body"))
    units = concepts.select("cik", "namespace", "concept", F.explode("body.units").alias("unit", "facts"))
    return units.select("cik", "namespace", "concept", "unit", F.inline("facts")).select(
        C.pad_cik(F.col("cik")).alias("cik"), "namespace", "concept", "unit",
        F.col("val").alias("value"), F.col("start").alias("period_start"), F.col("end").alias("period_end"),
        F.col("filed").alias("filed_date"), F.col("form").alias("form_type"), F.col("accn").alias("accession_no"),
    )


def metric_facts(rows: DataFrame, since: date | None = None) -> DataFrame:
    """Facts of the known metrics from their namespaces, filed since a day; for one key the shortest duration counts."""
    from marketweave.operators.ingest import dedupe

    known = rows.withColumn("metric", C.metric_of(F.col("concept"))).where(F.col("metric").isin(*C.METRICS) & C.right_namespace(F.col("namespace"), F.col("concept")))
    if since is not None:
        known = known.where(F.col("filed_date") >= F.lit(since))
    length = F.datediff("period_end", F.coalesce("period_start", "period_end"))
    return dedupe(known.drop("namespace", "concept"), ["cik", "metric", "period_end", "form_type", "accession_no"], [length, F.col("filed_date"), F.col("value")])


def parse_submissions(documents: DataFrame, document: str = "value") -> DataFrame:
    """Filing rows of a history document, which holds parallel arrays."""
    recent = "STRUCT<accessionNumber: ARRAY<STRING>, reportDate: ARRAY<STRING>, form: ARRAY<STRING>, primaryDocument: ARRAY<STRING>>"
    parsed = documents.select(F.from_json(F.col(document), F.lit(f"filings STRUCT<recent: {recent}>")).alias("d"))
    rows = parsed.select(F.inline(F.arrays_zip("d.filings.recent.accessionNumber", "d.filings.recent.reportDate", "d.filings.recent.form", "d.filings.recent.primaryDocument")))
    return rows.toDF("accession_no", "report_date", "form_type", "primary_document").withColumn("report_date", F.try_to_date("report_date", "yyyy-MM-dd"))


def parse_concept(documents: DataFrame, unit: str = "USD", document: str = "value") -> DataFrame:
    """Fact rows of one concept's document."""
    parsed = documents.select(F.from_json(F.col(document), F.lit(f"tag STRING, units MAP<STRING, ARRAY<STRUCT<{FACT}>>>")).alias("d"))
    return parsed.select(F.col("d.tag").alias("concept"), F.inline(F.element_at("d.units", unit)))


def filing_sections(filings: DataFrame, text: str = "text") -> DataFrame:
    """Rows (..., item, section): a filing's text cut at its item headings ("Item 1A.")."""
    cut = F.split(F.col(text), r"(?mi)^\s*(?=item\s+\d+[A-Z]?\.)")
    parts = filings.withColumn("section", F.explode(cut)).withColumn("item", F.upper(F.regexp_extract("section", r"(?i)^item\s+(\d+[A-Z]?)\.", 1)))
    return parts.where("item <> ''").withColumn("section", F.regexp_replace("section", r"(?i)^item\s+\d+[A-Z]?\.\s*|\s+$", "")).drop(text)


def latest_filing(filings: DataFrame, form: str = "10-K", by: str = "cik") -> DataFrame:
    """The newest filing of a form for each company."""
    rest = [c for c in filings.columns if c != by]
    newest = filings.where(C.base_form(F.col("form_type")) == form).groupBy(by).agg(F.max_by(F.struct(*rest), F.struct("filed_date", "accession_no")).alias("f"))
    return newest.select(by, "f.*").select(filings.columns)
