"""Thresholds and fixed dimensions of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Money tolerances are in millions."""

    confidence: float = 0.85
    abs_tolerance: float = 1.0
    rel_tolerance: float = 0.001
    rel_tolerance_hk: float = 0.05
    verification: float = 0.90


DEFAULTS = Settings()

#: Fixed values: (field, statement, scale) in output order.
FIELDS = (
    ("revenue", "income", "millions"),
    ("gross_profit", "income", "millions"),
    ("operating_income", "income", "millions"),
    ("net_income", "income", "millions"),
    ("eps_basic", "income", "per_share"),
    ("total_assets", "balance", "millions"),
    ("total_liabilities", "balance", "millions"),
    ("total_equity", "balance", "millions"),
    ("cash", "balance", "millions"),
    ("cfo", "cashflow", "millions"),
    ("cfi", "cashflow", "millions"),
    ("cff", "cashflow", "millions"),
    ("capex", "cashflow", "millions"),
)
#: Fixed values.
SPLIT_FACTORS = (2, 3, 4, 5, 6, 8, 10, 12, 20)
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A")
INSTANT_FIELDS = ("total_assets", "total_liabilities", "total_equity", "cash")
FISCAL_ENDS = ("12-31", "03-31", "06-30", "09-30")
OPENING_DAYS = ("01-01", "01-02", "01-03")
ANCHORS = ("revenue", "net_income", "gross_profit", "cfo", "total_assets")
KNOWN_SOURCES = ("pdf_grid", "pdf_text", "html_grid", "pdf")
