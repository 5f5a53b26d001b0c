"""Column lookup, table contracts and canonical projections.

Everything here looks at ``df.columns`` or adds projections: nothing starts a job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted column names, in order of preference.
PATIENT_ID_NAMES = ("patient_id", "donor_id", "donor", "sample_id")
GROUP_NAMES = ("disease_group", "disease_label", "disease", "group", "condition")
CELL_TYPE_NAMES = ("cell_type", "celltype", "cell_type_annotation", "annotation", "cell_label")
AGE_NAMES = ("age", "age_years", "donor_age", "patient_age")
SEX_NAMES = ("sex", "gender", "donor_sex", "patient_sex")
SOURCE_BATCH_NAMES = (
    "source", "batch", "dataset", "sample_source", "library", "library_id", "library_batch",
    "chemistry", "platform", "center", "site", "sequencing_batch", "processing_batch", "study",
    "accession",
)
# Feature columns a metadata-only model may not see.
EXPRESSION_COLUMN_PATTERNS = (r"^embedding(_|$)", r"^geneformer", r"^expr", r"^gene_", r"^pc\d*$")
# Tokens that mean "not known".
LEAKAGE_MISSING = ("", "TODO", "unclear", "None", "none", "null")
AUDIT_MISSING = ("", "TODO", "todo", "UNKNOWN", "unknown")
EXTERNAL_MISSING = AUDIT_MISSING + ("unresolved", "UNRESOLVED")
TRUE_TOKENS = ("true", "yes", "1")


class ContractError(ValueError):
    """A table does not have the columns or values an operator needs."""


def resolve_column(columns: Iterable[str], names: Sequence[str], required: bool = False) -> str | None:
    """First of ``names`` present in ``columns``: exact spelling first, then trimmed and case-folded."""
    columns = list(columns)
    folded = {c.strip().lower(): c for c in reversed(columns)}
    found = next((n for n in names if n in columns), None)
    found = found or next((folded[n.lower()] for n in names if n.lower() in folded), None)
    if found is None and required:
        raise ContractError(f"none of {list(names)} found in {columns}")
    return found


def batch_columns(columns: Iterable[str], exclude: Iterable[str] = ()) -> list[str]:
    """Every known source/batch column that is present, in the fixed order, minus ``exclude``."""
    columns, exclude = list(columns), set(exclude)
    found = [resolve_column(columns, (name,)) for name in SOURCE_BATCH_NAMES]
    kept = [c for c in dict.fromkeys(found) if c is not None and c not in exclude]
    reject_columns(kept)
    return kept


def require_columns(df: DataFrame | Sequence[str], names: Iterable[str]) -> None:
    columns = df.columns if isinstance(df, DataFrame) else list(df)
    missing = [n for n in names if n not in columns]
    if missing:
        raise ContractError("missing required columns: " + ", ".join(missing))


def require_header(df: DataFrame | Sequence[str], header: Sequence[str], exact: bool = True) -> None:
    """Header contract: the ordered list itself, or a required subset."""
    columns = df.columns if isinstance(df, DataFrame) else list(df)
    if not exact:
        return require_columns(columns, header)
    if list(columns) != list(header):
        raise ContractError(f"header is {columns}, expected {list(header)}")


def reject_columns(columns: Iterable[str], patterns: Sequence[str] = EXPRESSION_COLUMN_PATTERNS) -> None:
    bad = [c for c in columns if any(re.search(p, c.strip().lower()) for p in patterns)]
    if bad:
        raise ContractError("columns not allowed as metadata features: " + ", ".join(bad))


def model_features(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of a donor table that a metadata model may use."""
    reject_columns(df.columns)
    numeric = [c for c in df.columns if c in ("age", "n_cells") or c.startswith(("cell_type_prop_", "tech_count_"))]
    categorical = [c for c in df.columns if c == "sex"]
    if not numeric and not categorical:
        raise ContractError("no usable feature columns")
    return numeric, categorical


def availability(df: DataFrame) -> dict[str, bool]:
    """Which roles a cell table can fill, answered from its schema alone."""
    roles = {
        "patient_id_available": PATIENT_ID_NAMES,
        "label_available": GROUP_NAMES,
        "age_available": AGE_NAMES,
        "sex_available": SEX_NAMES,
        "cell_type_available": CELL_TYPE_NAMES,
    }
    report = {role: resolve_column(df.columns, names) is not None for role, names in roles.items()}
    report["source_batch_available"] = bool(batch_columns(df.columns))
    return report


def rename_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename source fields to canonical ones; fields absent from the table are ignored."""
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def canonical(df: DataFrame, strings: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Ids and labels as trimmed strings, numbers coerced (unreadable becomes NULL)."""
    out = {c: F.trim(F.col(c).cast("string")) for c in strings}
    out |= {c: F.col(c).try_cast("double") for c in numbers}
    return df.withColumns(out)


def drop_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows whose ids/labels are neither NULL nor blank."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.trim(F.col(c).cast("string")) != "")
    return df.where(keep)


def is_missing(column: Column | str, tokens: Sequence[str] = LEAKAGE_MISSING) -> Column:
    c = F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))
    return c.isNull() | c.isin(*tokens)


def normalize_missing(df: DataFrame, columns: Sequence[str], tokens=AUDIT_MISSING, fill: str = "TODO") -> DataFrame:
    """Trim text and write one token for every kind of missing."""
    return df.withColumns(
        {c: F.when(is_missing(c, tokens), F.lit(fill)).otherwise(F.trim(F.col(c).cast("string"))) for c in columns}
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; used where results are compared across engines."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
