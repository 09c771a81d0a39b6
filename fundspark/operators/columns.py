"""Whole-frame column work: renames, tax-id cleanup, defaults, conforming to a schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundspark.functions.dates import fix_invalid_date
from fundspark.functions.numbers import null_if_zero, zero_if_empty
from fundspark.functions.text import fixed_chars, pad_tax_id, strip_tax_id, truncate


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def rename_present(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; a rename onto an existing column is skipped."""
    return df.withColumnsRenamed(
        {old: new for old, new in renames.items() if old in df.columns and new not in df.columns}
    )


def clean_tax_ids(df: DataFrame, pad: bool = True) -> DataFrame:
    """Strip every ``cnpj`` column; pad company ids, but not ids that may be personal."""
    cleaned = {}
    for name in df.columns:
        if "cnpj" in name.lower():
            padded = pad and "cpf" not in name.lower()
            cleaned[name] = (pad_tax_id if padded else strip_tax_id)(F.col(name))
    return df.withColumns(cleaned) if cleaned else df


def with_default(df: DataFrame, name: str, value: object) -> DataFrame:
    """Add the column when absent and fill its NULLs."""
    if name not in df.columns:
        return df.withColumn(name, F.lit(value))
    return df.fillna({name: value})


def cut_text(df: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    return df.withColumns(
        {n: truncate(F.col(n), size) for n, size in lengths.items() if n in df.columns}
    )


def clean_chars(df: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    return df.withColumns(
        {n: fixed_chars(F.col(n), size) for n, size in lengths.items() if n in df.columns}
    )


def fix_dates(df: DataFrame, names: Iterable[str], nanosecond_range: bool = False) -> DataFrame:
    return df.withColumns(
        {n: fix_invalid_date(F.col(n), nanosecond_range) for n in names if n in df.columns}
    )


def conform(
    df: DataFrame, schema: T.StructType, extra: str = "raise", on_loss: str = "null"
) -> DataFrame:
    """Shape ``df`` like a target table: its columns, its order, its types.

    Absent columns and blank texts are NULL. Values that do not fit the type become NULL
    (``cast_losses`` counts them); ``on_loss="fail"`` fails the job instead, naming column
    and value. ``extra="drop"`` ignores unknown columns.
    """
    if on_loss not in ("null", "fail"):
        raise ValueError(on_loss)
    known = {f.name for f in schema}
    unknown = [c for c in df.columns if c not in known]
    if unknown and extra == "raise":
        raise ValueError(f"columns not in the target table: {unknown}")
    present = dict(df.dtypes)
    columns, cast = [], {}
    for field in schema:
        kind, value = field.dataType.simpleString(), f"`{field.name}`"
        if field.name not in present:
            value = f"CAST(NULL AS {kind})"
        elif present[field.name] != kind:
            typed = f"try_cast({value} AS {kind})"
            if on_loss == "fail":
                # Cast once, in a projection of its own; only what came out NULL is looked at again.
                cast[f"_typed_{field.name}"] = F.expr(typed)
                what = f"raise_error(concat('{field.name} cannot hold ', {value}))"
                typed = f"`_typed_{field.name}`"
                lost = f"{typed} IS NULL AND trim(CAST({value} AS STRING)) <> ''"
                typed = f"CASE WHEN {lost} THEN {what} ELSE {typed} END"
            value = typed
        columns.append(f"{value} AS `{field.name}`")
    return df.withColumns(cast).selectExpr(*columns)


def cast_losses(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: per target column, how many values, blanks apart, would not fit its type."""
    lost = [
        F.count_if((F.trim(F.col(f.name).cast("string")) != "") & F.col(f.name).try_cast(f.dataType).isNull()).alias(
            f.name
        )
        for f in schema
        if f.name in df.columns
    ]
    return df.agg(*lost)


def serve(
    df: DataFrame, zero: Iterable[str] = (), nullable: Iterable[str] = ()
) -> DataFrame:
    """Serving shape: ``zero`` columns as doubles with 0 for NULL, ``nullable`` ones
    as doubles with NULL for 0."""
    return df.withColumns(
        {
            **{n: zero_if_empty(F.col(n)) for n in zero},
            **{n: null_if_zero(F.col(n)) for n in nullable},
        }
    )


def with_lineage(df: DataFrame) -> DataFrame:
    """Attach the processing date and the source file name of a file-based frame."""
    return df.withColumns(
        {"data_processamento": F.current_date(), "arquivo_origem": F.col("_metadata.file_name")}
    )
