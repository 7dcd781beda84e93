"""Pure Column functions (no DataFrame, no Python per row).

Everything here compiles to built-in Catalyst expressions and stays inside
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens.functions import constants as K

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- flags and predicates -------------------------------------------------

def flag(cond: Column) -> Column:
    """0/1 integer from a boolean where null counts as 0 (not null)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def is_other_vendor(vendor: ColumnOrName) -> Column:
    """True unless the vendor is exactly TPFP or TPSD; a missing vendor is 'other'."""
    v = _c(vendor)
    return ~v.eqNullSafe(K.VENDOR_AFTER_LEAVE) & ~v.eqNullSafe(K.VENDOR_SALARY)


def contains_class(col: ColumnOrName, class_name: str) -> Column:
    """Owner/model type text contains the literal `App\\<class_name>`."""
    return _c(col).contains("App\\" + class_name)


def map_codes(col: ColumnOrName, mapping: Mapping) -> Column:
    """Code -> label; unknown codes and nulls give null (no default)."""
    c = _c(col)
    out = None
    for code, label in mapping.items():
        out = F.when(c == F.lit(code), F.lit(label)) if out is None else out.when(c == F.lit(code), F.lit(label))
    return out


def loan_type(merchant_id: ColumnOrName, loan_id: ColumnOrName) -> Column:
    """Plus merchant -> plus label; any other loan -> base label; no loan -> null."""
    return F.when(_c(merchant_id) == K.PLUS_MERCHANT_ID, F.lit(K.LOAN_TYPE_PLUS)).when(
        _c(loan_id).isNotNull(), F.lit(K.LOAN_TYPE_BASE)
    )


# --- banding / scorecards ---------------------------------------------------

_OPS = {
    "<": lambda c, b: c < b,
    "<=": lambda c, b: c <= b,
    ">": lambda c, b: c > b,
    ">=": lambda c, b: c >= b,
}


def band(col: ColumnOrName, bands: Sequence, null_value, other) -> Column:
    """Ordered banding, first match wins: bands = [(op, bound, value), ...]."""
    c = _c(col)
    out = F.when(c.isNull(), F.lit(null_value))
    for op, bound, value in bands:
        out = out.when(_OPS[op](c, F.lit(bound)), F.lit(value))
    return out.otherwise(F.lit(other))


def band_values(col: ColumnOrName, values: Sequence, null_value, other) -> Column:
    """Categorical banding: values = [((v1, v2, ...), points), ...]."""
    c = _c(col)
    out = F.when(c.isNull(), F.lit(null_value))
    for members, points in values:
        out = out.when(c.isin(list(members)), F.lit(points))
    return out.otherwise(F.lit(other))


def score_card(col: ColumnOrName, card: Mapping) -> Column:
    """Points from a card given as data (numeric bands or categorical values)."""
    if "bands" in card:
        return band(col, card["bands"], card["null"], card["other"])
    return band_values(col, card["values"], card["null"], card["other"])


def rating(score: ColumnOrName, bounds=K.RATING_BOUNDS, floor=K.RATING_FLOOR) -> Column:
    """Letter rating: above bound_i -> label_i (in order); otherwise floor; null -> null."""
    s = _c(score)
    out = None
    for bound, label in bounds:
        out = F.when(s > bound, F.lit(label)) if out is None else out.when(s > bound, F.lit(label))
    return out.when(s <= bounds[-1][0], F.lit(floor))


def income_midpoint(col: ColumnOrName, strict: bool = False) -> Column:
    """Declared income band text -> midpoint, else the text read as a number.

    Unknown text raises when `strict` (warehouse behaviour), else gives null.
    """
    c = _c(col)
    out = None
    for text, mid in K.INCOME_BAND_MIDPOINTS.items():
        m = F.lit(mid).cast("decimal(38,9)")
        out = F.when(c == text, m) if out is None else out.when(c == text, m)
    parsed = c.cast("decimal(38,9)") if strict else c.try_cast("decimal(38,9)")
    return out.otherwise(parsed)


# --- dates ----------------------------------------------------------------

def days_between(end: ColumnOrName, start: ColumnOrName) -> Column:
    """Whole days end - start, on the date parts."""
    return F.datediff(_c(end).cast("date"), _c(start).cast("date"))


def year_fraction(end: ColumnOrName, start: ColumnOrName) -> Column:
    """(end - start) in days / 365, as double."""
    return days_between(end, start) / F.lit(365.0)


def loose_date(col: ColumnOrName, strict: bool = False) -> Column:
    """Date from text by length: 6 -> YYYY?M, 7 -> YYYY?MM, 10 -> YYYY?MM?DD.

    The separator is not checked and the day defaults to 1. Other lengths
    give null; impossible dates give null (or raise when `strict`).
    """
    c = _c(col)
    n = F.length(c)
    year = F.substring(c, 1, 4)
    month = F.when(n == 6, F.substring(c, 6, 1)).when(n.isin(7, 10), F.substring(c, 6, 2))
    day = F.when(n == 10, F.substring(c, 9, 2)).otherwise(F.lit("1"))
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    parsed = F.to_date(text, "yyyy-MM-dd") if strict else F.try_to_date(text, "yyyy-MM-dd")
    return F.when(n.isin(6, 7, 10), parsed)


def try_date(col: ColumnOrName, fmt: str = "yyyy-MM-dd") -> Column:
    """Parse text to date; invalid -> null. Dates and timestamps pass through as dates."""
    return F.try_to_date(_c(col).cast("string"), fmt)


def add_months(ts: ColumnOrName, months: int) -> Column:
    """Calendar month shift clamped to month end, keeping the time of day."""
    return _c(ts) + F.make_ym_interval(F.lit(0), F.lit(months))


def month_floor_prev(ts: ColumnOrName) -> Column:
    """First day (00:00) of the month of `ts - 1 month`, as timestamp_ntz."""
    shifted = add_months(_c(ts), -1).cast("date")
    return F.trunc(shifted, "MM").cast("timestamp_ntz")


def as_ntz(col: ColumnOrName) -> Column:
    """Date or timestamp_ntz as timestamp_ntz (midnight for dates)."""
    return _c(col).cast("timestamp_ntz")


def month_label(ts: ColumnOrName) -> Column:
    """`YYYY-MM` of a date or timestamp."""
    return F.date_format(_c(ts), "yyyy-MM")


def to_manila(ts_utc: ColumnOrName) -> Column:
    """UTC wall time -> Manila civil time (timestamp_ntz in, timestamp_ntz out)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(K.MANILA_TZ), _c(ts_utc))


# --- text -------------------------------------------------------------------

def null_tokens(col: ColumnOrName, tokens: Sequence[str] = K.NULL_TOKENS) -> Column:
    """Null-like text ('<NA>', 'None', 'nan', '', ...) -> null."""
    c = _c(col)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def extract_or_null(col: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """First regex match group, or null when nothing matches."""
    return F.nullif(F.regexp_extract(_c(col), pattern, group), F.lit(""))


def clean_reference(col: ColumnOrName, mode: str = "strict") -> Column:
    """Device reference number cleaning.

    strict:  uuid after ':' or '#', else a 31+ character token after them, else null.
    lenient: uuid anywhere; text after ':' up to ':', '#' or 'W'; after '#digits:';
             a 20+ character token; the text without leading [#0-9:W]; the text.
    """
    c = _c(col)
    if mode == "strict":
        return F.coalesce(extract_or_null(c, K.UUID_AFTER_DELIM), extract_or_null(c, K.LONG_TOKEN_AFTER_DELIM))
    if mode == "lenient":
        return F.coalesce(
            extract_or_null(c, K.UUID_ANYWHERE),
            extract_or_null(c, K.AFTER_COLON),
            extract_or_null(c, K.AFTER_HASH_DIGITS),
            extract_or_null(c, K.LONG_TOKEN),
            F.regexp_replace(c, K.LEADING_NOISE, ""),
            c,
        )
    raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")


def strip_device_prefix(col: ColumnOrName) -> Column:
    """Drop a leading `#<digits>:` from a device id."""
    return F.regexp_replace(_c(col), K.DEVICE_PREFIX, "")


def json_scalar(col: ColumnOrName, key: str, strict: bool = False) -> Column:
    """Scalar at `$.key` of JSON text as string; objects/arrays and bad JSON -> null.

    With `strict`, malformed JSON raises instead.
    """
    doc = F.parse_json(_c(col)) if strict else F.try_parse_json(_c(col))
    path = f"$.{key}"
    value = F.try_variant_get(doc, path, "variant")
    kind = F.schema_of_variant(value)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(~nested | kind.isNull(), F.try_variant_get(doc, path, "string"))


def money(col: ColumnOrName) -> Column:
    """Decimal money -> double at the output edge."""
    return _c(col).cast("double")


# --- conditional aggregates -----------------------------------------------

def sum_if(cond: Column, value: ColumnOrName | int = 1) -> Column:
    """sum(case when cond then value else 0 end): a count or a volume."""
    v = F.lit(value) if isinstance(value, int) else _c(value)
    return F.sum(F.when(cond, v).otherwise(F.lit(0)))


def min_if(cond: Column, value: ColumnOrName) -> Column:
    """min(case when cond then value end): null when nothing matches."""
    return F.min(F.when(cond, _c(value)))


def max_if(cond: Column, value: ColumnOrName) -> Column:
    """max(case when cond then value end): null when nothing matches."""
    return F.max(F.when(cond, _c(value)))


def any_flag(cond: Column) -> Column:
    """1 if any row of the group matches, else 0."""
    return F.max(flag(cond))


def pivot_nth(pos: ColumnOrName, value: ColumnOrName, n: int, name: str) -> list[Column]:
    """Value at position 1..n as one column each (`<name>_<k>`), without a pivot shuffle."""
    return [min_if(_c(pos) == k, value).alias(f"{name}_{k}") for k in range(1, n + 1)]


# --- parsing ------------------------------------------------------------------

def parse_date(col: ColumnOrName, fmt: str = "yyyy-MM-dd", strict: bool = False) -> Column:
    """Text -> date; invalid text gives null, or raises when `strict`."""
    c = _c(col).cast("string")
    return F.to_date(c, fmt) if strict else F.try_to_date(c, fmt)


def parse_number(col: ColumnOrName, strict: bool = False) -> Column:
    """Text -> double; invalid text gives null, or raises when `strict`."""
    return _c(col).cast("double") if strict else _c(col).try_cast("double")


def nan_to_null(col: ColumnOrName) -> Column:
    """Floating NaN -> null (pandas treats NaN as missing; Spark would count
    it, compare it above every number and return it from max)."""
    c = _c(col)
    return F.when(~F.isnan(c), c)
