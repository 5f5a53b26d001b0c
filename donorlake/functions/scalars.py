"""Scalar expressions over donor, gene, file and vector columns (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from donorlake.functions.columns import TRUE_TOKENS

# Donor id patterns and their clinical status.
FLARE_PATTERN = "(?i)^FLARE"
HEALTHY_PATTERN = "(?i)^(HC-|IGTB)"
MANAGED_PATTERN = "^[0-9]+$"
CLINICAL_STATUSES = ("Flare", "Managed", "Healthy")
# Fixed value: the only development-stage text an age is read from.
AGE_PATTERN = r"^(\d+)-year-old stage$"
MITO_PREFIX = "MT-"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def sanitize(column: Column | str) -> Column:
    """Lower case, runs of other characters to ``_``, no outer ``_``; empty becomes ``unknown``."""
    cleaned = F.regexp_replace(F.lower(F.trim(_c(column).cast("string"))), "[^0-9a-z]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def donor_id(column: Column | str) -> Column:
    """Trimmed id; NULL or blank fails the query."""
    c = F.trim(_c(column).cast("string"))
    return F.when(c.isNull() | (c == "") | (F.lower(c) == "nan"), F.raise_error(F.lit("donor id is missing"))).otherwise(c)


def donor_status(column: Column | str, on_unknown: str = "error", default: str = "Managed") -> Column:
    """Clinical status from the id pattern. Unknown patterns fail, or take ``default``."""
    c = donor_id(column)
    if on_unknown not in ("error", "default"):
        raise ValueError("on_unknown must be 'error' or 'default'")
    unknown = (
        F.raise_error(F.concat(F.lit("unrecognized donor id: "), c)).cast("string")
        if on_unknown == "error"
        else F.lit(default)
    )
    return (
        F.when(c.rlike(FLARE_PATTERN), "Flare")
        .when(c.rlike(HEALTHY_PATTERN), "Healthy")
        .when(c.rlike(MANAGED_PATTERN), "Managed")
        .otherwise(unknown)
    )


def donor_group_by_prefix(column: Column | str) -> Column:
    """Case-sensitive prefix variant in which everything else counts as Managed."""
    c = _c(column)
    return (
        F.when(c.startswith("FLARE"), "Flare")
        .when(c.startswith("HC-") | c.startswith("IGTB"), "Healthy")
        .otherwise("Managed")
    )


def file_category(column: Column | str) -> Column:
    """Kind of donor a file stem looks like."""
    c = _c(column)
    return (
        F.when(c.startswith("FLARE"), "flare_like")
        .when(c.startswith("HC-"), "healthy_hc_like")
        .when(c.startswith("IGTB"), "healthy_igtb_like")
        .when(c == "ICC_control", "control_like")
        .when(c.rlike(MANAGED_PATTERN), "managed_sle_numeric_like")
        .otherwise("other")
    )


def parse_age(column: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(column), AGE_PATTERN, 1), F.lit("")).try_cast("int")


def is_mito(column: Column | str, prefix: str = MITO_PREFIX) -> Column:
    """Mitochondrial flag of a gene symbol; a blank symbol fails the query."""
    c = F.trim(_c(column).cast("string"))
    flag = F.upper(c).startswith(prefix.upper())
    return F.when(c.isNull() | (c == ""), F.raise_error(F.lit("gene symbol is missing")).cast("boolean")).otherwise(flag)


def as_true(column: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(column).cast("string"))).isin(*TRUE_TOKENS), F.lit(False))


def is_finite(column: Column | str) -> Column:
    c = _c(column).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def vector_problem(column: Column | str, size: int | None = None) -> Column:
    """NULL for a usable vector, otherwise what is wrong with it."""
    c = _c(column)
    wrong_size = F.lit(False) if size is None else F.size(c) != size
    return (
        F.when(c.isNull() | (F.size(c) == 0), "empty vector")
        .when(F.exists(c, lambda x: ~is_finite(x)), "non-finite value")
        .when(wrong_size, "unexpected size")
    )


def numeric_vector(column: Column | str) -> Column:
    """Array of text to array of double; a value that is no number becomes NULL."""
    return F.transform(_c(column), lambda x: x.try_cast("double"))


def euclidean(left: Column | str, right: Column | str) -> Column:
    squares = F.zip_with(_c(left), _c(right), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def inverse_distance(distance: Column | str) -> Column:
    return F.lit(1.0) / (_c(distance) + F.lit(1.0))


def joined(column: Column | str, separator: str = "|") -> Column:
    """Distinct values of an array, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(_c(column))), separator)


def json_doubles(column: Column | str) -> Column:
    return F.from_json(_c(column), "array<double>")


def array_median(column: Column | str) -> Column:
    """Median of a (short) array column."""
    s = F.array_sort(_c(column))
    n = F.size(s)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    high = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def composite_key(*columns: Column | str) -> Column:
    return F.concat_ws("::", *[F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))) for c in columns])


def direction(shift: Column | str) -> Column:
    c = _c(shift)
    return F.when(c > 0, "increase").when(c < 0, "decrease").otherwise("no_change")


def run_stamp() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def warning_level(value: Column | str, moderate: float, strong: float) -> Column:
    """none / flag / strong by absolute size; anything not finite is not_estimable."""
    c = _c(value)
    return (
        F.when(~is_finite(c), "not_estimable")
        .when(F.abs(c) >= strong, "strong")
        .when(F.abs(c) >= moderate, "flag")
        .otherwise("none")
    )


def safe_ratio(numerator: Column, denominator: Column, zero_division: str = "zero") -> Column:
    """Division with 0.0 or NaN where the denominator is zero."""
    if zero_division not in ("zero", "nan"):
        raise ValueError("zero_division must be 'zero' or 'nan'")
    fallback = 0.0 if zero_division == "zero" else float("nan")
    return F.when(denominator == 0, F.lit(fallback)).otherwise(numerator.cast("double") / denominator)


def any_of(columns: Sequence[str], test) -> Column:
    """True when ``test`` holds for at least one of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(test(F.col(c)), F.lit(False))
    return hit
