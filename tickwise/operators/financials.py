"""Financial statements: from line-item maps to one row per report period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.periods import FIRST_FISCAL_YEAR, annual_periods, period_label, quarter_periods, statement_key

# Line items of a statement, whole amounts.
AMOUNT_ITEMS = [
    "revenue",
    "cost_of_revenue",
    "gross_profit",
    "operating_income",
    "total_assets",
    "total_current_assets",
    "prepaid_expenses",
    "property_plant_and_equipment_net",
    "retained_earnings",
    "other_assets_noncurrent",
    "total_non_current_assets",
    "total_liabilities",
    "shareholder_equity",
    "net_income",
    "shares_outstanding_diluted",
    "shares_outstanding_basic",
    "operating_cash_flow",
    "investing_cash_flow",
    "financing_cash_flow",
    "net_cash_flow",
    "research_development_expense",
    "selling_general_administrative_expense",
    "operating_expenses",
    "non_operating_income",
    "pre_tax_income",
    "income_tax",
    "depreciation_amortization",
    "stock_based_compensation",
    "dividends_paid",
    "cash_on_hand",
    "current_net_receivables",
    "inventory",
    "total_current_liabilities",
    "total_non_current_liabilities",
    "long_term_debt",
    "total_long_term_liabilities",
    "goodwill",
    "intangible_assets_excluding_goodwill",
]
# Line items of a statement, per share.
PER_SHARE_ITEMS = ["eps_diluted", "eps_basic"]
ITEMS = AMOUNT_ITEMS + PER_SHARE_ITEMS

ITEM_MAP = "MAP<STRING, DOUBLE>"
STATEMENT_TYPE = "STRUCT<" + ", ".join(f"{i}: {ITEM_MAP}" for i in ITEMS) + ">"
RESPONSE_SCHEMA = (
    "currency STRING, company_info STRUCT<cik: STRING, ticker: STRING, name: STRING>, "
    f"financial_data STRUCT<annual: {STATEMENT_TYPE}, quarterly: {STATEMENT_TYPE}>"
)


def has_statements(annual: str = "financial_data.annual", quarterly: str = "financial_data.quarterly") -> Column:
    """A response must hold annual or quarterly statements."""
    return F.coalesce(F.col(annual).isNotNull(), F.lit(False)) | F.coalesce(F.col(quarterly).isNotNull(), F.lit(False))


def report_rows(responses: DataFrame, as_of: Column, kind: str, first_year: int = FIRST_FISCAL_YEAR) -> DataFrame:
    """One row per company and ended report period of ``kind`` ``"A"`` or ``"Q"``.

    Annual periods read the annual statements and fall back to the quarterly ones;
    quarters need quarterly statements.  Amounts are cut to whole numbers.
    """
    annual, quarterly = F.col("financial_data.annual"), F.col("financial_data.quarterly")
    periods = annual_periods(as_of, first_year) if kind == "A" else quarter_periods(as_of, first_year)
    source = F.coalesce(annual, quarterly) if kind == "A" else quarterly
    rows = (
        responses.filter(has_statements())
        .select("currency", F.col("company_info.ticker").alias("ticker"), source.alias("s"), F.explode(periods).alias("p"))
        .filter(F.col("s").isNotNull())
        .withColumn("key", statement_key("p.fiscal_year", "p.period"))
    )

    def item(name: str) -> Column:
        value = F.try_element_at(F.col(f"s.{name}"), F.col("key"))
        return (value if name in PER_SHARE_ITEMS else value.cast("long")).alias(name)

    return rows.select(
        "ticker",
        period_label("p.fiscal_year", "p.period").alias("report_period"),
        F.col("p.fiscal_year").alias("fiscal_year"),
        F.col("p.period").alias("period"),
        "currency",
        *[item(i) for i in ITEMS],
    )


def new_periods(reports: DataFrame, stored: DataFrame) -> DataFrame:
    """Report rows whose period is not stored yet."""
    return reports.join(stored.select("ticker", "report_period").distinct(), ["ticker", "report_period"], "left_anti")


def statements(reports: DataFrame, ticker: str | None = None, period: str | None = None) -> DataFrame:
    """Stored statements, optionally of one ticker and one period."""
    kept = reports
    if ticker:
        kept = kept.filter(F.col("ticker") == ticker)
    if period:
        kept = kept.filter(F.col("report_period") == period)
    return kept


def responses_from_totals(totals: DataFrame, currency: str = "USD") -> DataFrame:
    """Statement responses derived from one total per ticker, year and quarter.

    Item number ``i`` is the total times ``(i + 1) / 100``.
    """
    quarter_key = F.concat(F.col("year"), F.lit("-Q"), F.col("quarter"))
    quarterly = totals.groupBy("ticker").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(quarter_key, "total")))).alias("quarterly")
    )
    yearly = totals.groupBy("ticker", "year").agg(F.round(F.sum("total"), 2).alias("total"))
    annual = yearly.groupBy("ticker").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("year").cast("string"), "total")))).alias("annual")
    )

    def share(source: str, part: float) -> Column:
        return F.transform_values(source, lambda _, v: v * part)

    def statement(source: str) -> Column:
        return F.struct(*[share(source, (n + 1) / 100).alias(i) for n, i in enumerate(ITEMS)]).alias(source)

    return annual.join(quarterly, "ticker").select(
        F.lit(currency).alias("currency"),
        F.struct(F.lit("0").alias("cik"), F.col("ticker"), F.col("ticker").alias("name")).alias("company_info"),
        F.struct(statement("annual"), statement("quarterly")).alias("financial_data"),
    )


def sample_companies(universe: DataFrame, n: int, seed: int) -> DataFrame:
    """Random companies for one run; the hash order is the same wherever it runs."""
    kept = universe.filter(~F.coalesce(F.col("skip"), F.lit(False))) if "skip" in universe.columns else universe
    return kept.orderBy(F.xxhash64(F.lit(seed), "ticker"), "ticker").limit(n)
