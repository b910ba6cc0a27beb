"""Column-level helpers (no data movement): text cleaning, sentinels, dates, casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the source data model (must equal the reference's).
LEAVE_DATE_SENTINEL = "31/12/1900"   # DTDEM of a member who has not left
BIRTH_DATE_SENTINEL = "0000-00-00"   # DTNAIS unknown
REFERENCE_DATE = "2007-01-01"        # extraction date used for ages and tenures
DAYS_PER_YEAR = 365.25
MISSING_TOKEN = "__MANQUANT__"       # structurally missing category (leave motive of stayers)
# Text read as missing by the CSV reader (pandas' default NA tokens).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    """Remove leading/trailing whitespace of any kind (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(col).cast("string"), r"^\s+|\s+$", "")


def leave_target(col: str | Column = "DTDEM", sentinel: str = LEAVE_DATE_SENTINEL) -> Column:
    """1 unless the stripped leave date equals the sentinel; a NULL date counts as 1."""
    return (~strip(col).eqNullSafe(F.lit(sentinel))).cast("int")


def parse_iso_date(col: str | Column, sentinel: str = BIRTH_DATE_SENTINEL) -> Column:
    """ISO date, sentinel and unparsable text -> NULL (``to_date`` would raise under ANSI)."""
    return F.try_to_date(F.nullif(strip(col), F.lit(sentinel)), "yyyy-MM-dd")


def parse_dmy_date(col: str | Column) -> Column:
    """Day-first date, padded (``05/01/2001``) or not (``5/1/2001``); unparsable text -> NULL."""
    return F.try_to_date(strip(col), "d/M/yyyy")


def years_to_reference(date_col: str | Column, reference: str = REFERENCE_DATE) -> Column:
    """Whole days between the date and the reference date, divided by 365.25."""
    return F.datediff(F.lit(reference).cast("date"), _c(date_col)) / F.lit(DAYS_PER_YEAR)


def sanitize_name(col: str | Column) -> Column:
    """File-name-safe label: every run of characters other than letters, digits, '_' and '-' -> '_'."""
    return F.regexp_replace(_c(col), r"[^A-Za-z0-9_\-]+", "_")


def pair_key(a: str | Column, b: str | Column) -> Column:
    """Canonical, order-free key of a column pair."""
    return F.concat_ws("__", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi] keeping NULL as NULL (``greatest``/``least`` skip NULL arguments); NaN is NULL."""
    y = x
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).otherwise(y)


def number(col: str | Column) -> Column:
    """The value as a double; NaN is missing, like NULL."""
    x = _c(col).cast("double")
    return F.when(~F.isnan(x), x)
