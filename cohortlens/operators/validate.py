"""Validation of raw customer tables: fail-fast and quarantine forms.

Checks run in a fixed order and the first failing check decides the
message: required columns, not empty, at least 5 rows, gender domain,
numeric coercion, age range, income sign, score range.  The fail-fast form
evaluates all row-level checks in ONE aggregate pass (map-side partial
counts) plus a top-5 distinct subquery for the offending gender values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C

MISSING_COLUMNS = "missing_columns"
REASONS = ["invalid_gender", "invalid_numeric", "age_out_of_range", "negative_income", "score_out_of_range"]


class ValidationError(ValueError):
    pass


def missing_columns(df: DataFrame) -> list[str]:
    """Required public columns absent from the schema (no job is run)."""
    have = set(df.columns)
    return [c for c in S.REQUIRED_PUBLIC if c not in have]


def check_columns(df: DataFrame) -> None:
    missing = missing_columns(df)
    if missing:
        raise ValidationError(S.MSG_MISSING.format(required=", ".join(S.REQUIRED_PUBLIC),
                                                   missing=", ".join(missing)))


def normalize(raw: DataFrame) -> DataFrame:
    """Rename to internal names, normalise gender, coerce numbers, derive row flags.

    Extra columns of the file are kept.
    """
    check_columns(raw)
    P = S.PUBLIC_NAMES
    extra = [c for c in raw.columns if c not in S.REQUIRED_PUBLIC]
    df = raw.select(
        *[F.col(f"`{P[c]}`").cast("string").alias(f"{c}_raw") for c in S.INTERNAL_COLUMNS],
        *[F.col(f"`{c}`") for c in extra],
    )
    df = df.withColumn(S.GENDER, C.normalize_gender(f"{S.GENDER}_raw"))
    for c in S.NUMERIC_COLUMNS:
        df = df.withColumn(f"{c}_num", C.to_number(f"{c}_raw"))
    nums = [F.col(f"{c}_num") for c in S.NUMERIC_COLUMNS]
    numeric_bad = F.lit(False)
    for n in nums:
        numeric_bad = numeric_bad | n.isNull() | (F.abs(n) == F.lit(float("inf")))
    id_trunc = F.col(f"{S.CUSTOMER_ID}_num").try_cast("bigint")  # truncates toward zero, NULL on overflow
    numeric_bad = numeric_bad | (F.col(f"{S.CUSTOMER_ID}_num").isNotNull() & id_trunc.isNull())
    age_trunc = F.col(f"{S.AGE}_num").try_cast("bigint")  # truncation before the range check
    inc = F.col(f"{S.INCOME}_num")
    sc = F.col(f"{S.SCORE}_num")
    return (
        df.withColumn("_gender_bad", ~F.col(S.GENDER).isin(S.VALID_GENDERS))
        .withColumn("_numeric_bad", numeric_bad)
        .withColumn("_age_t", age_trunc)
        .withColumn("_id_t", id_trunc)
        .withColumn("_age_bad", F.when(F.col("_age_t").isNull(), F.col(f"{S.AGE}_num").isNotNull())
                    .otherwise(~F.col("_age_t").between(S.AGE_MIN, S.AGE_MAX)))
        .withColumn("_income_bad", inc < 0)
        .withColumn("_score_bad", ~sc.between(S.SCORE_MIN, S.SCORE_MAX))
    )


def reject_reason(missing_columns: Column | None = None) -> Column:
    """First failing check, or NULL for a good row (quarantine form).

    ``missing_columns``: the absent column names of the row's upload, if any.
    """
    absent = F.lit(False) if missing_columns is None else missing_columns.isNotNull()
    return (
        F.when(absent, MISSING_COLUMNS)
        .when(F.col("_gender_bad"), REASONS[0])
        .when(F.col("_numeric_bad"), REASONS[1])
        .when(F.col("_age_bad"), REASONS[2])
        .when(F.col("_income_bad"), REASONS[3])
        .when(F.col("_score_bad"), REASONS[4])
    )


def typed(norm: DataFrame) -> DataFrame:
    """Narrow to the validated schema (only meaningful on good rows)."""
    extra = [c for c in norm.columns
             if not c.startswith("_") and not c.endswith(("_raw", "_num"))
             and c not in (S.GENDER, "reject_reason")]
    return norm.select(
        F.col("_id_t").alias(S.CUSTOMER_ID),
        F.col(S.GENDER),
        F.col("_age_t").cast("smallint").alias(S.AGE),
        F.col(f"{S.INCOME}_num").alias(S.INCOME),
        F.col(f"{S.SCORE}_num").alias(S.SCORE),
        *extra,
    )


def invalid_gender_values(norm: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` distinct offending gender values in sorted order (top-k)."""
    return (norm.filter(F.col("_gender_bad")).select(S.GENDER).distinct()
            .orderBy(S.GENDER).limit(limit))


def summary(raw: DataFrame) -> DataFrame:
    """One-row validation summary with the fail-fast message (NULL when valid).

    ONE pass over the rows: a grouped aggregate by normalised gender carries
    every check's count (map-side partials; the valid genders are two hot
    keys, which partial aggregation absorbs).  The totals and the top-5
    offending values are both read from that aggregate, whose exchange Spark
    reuses for the scalar subquery.
    """
    norm = normalize(raw)
    by_gender = norm.groupBy(S.GENDER).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_numeric_bad")).alias("nb"),
        F.count_if(F.col("_age_bad")).alias("ab"),
        F.count_if(F.col("_income_bad")).alias("ib"),
        F.count_if(F.col("_score_bad")).alias("sb"),
    )
    bad_gender = ~F.col(S.GENDER).isin(S.VALID_GENDERS)
    found = (by_gender.filter(bad_gender).select(S.GENDER).orderBy(S.GENDER).limit(5)
             .agg(F.array_join(F.array_sort(F.collect_list(S.GENDER)), ", ")).scalar())
    agg = by_gender.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(bad_gender, F.col("n"))), F.lit(0)).alias("invalid_gender_rows"),
        F.coalesce(F.sum("nb"), F.lit(0)).alias("invalid_numeric_rows"),
        F.coalesce(F.sum("ab"), F.lit(0)).alias("age_out_of_range_rows"),
        F.coalesce(F.sum("ib"), F.lit(0)).alias("negative_income_rows"),
        F.coalesce(F.sum("sb"), F.lit(0)).alias("score_out_of_range_rows"),
    )
    gender_prefix = S.MSG_GENDER.split("{found}")[0]
    msg = (
        F.when(F.col("total_rows") == 0, S.MSG_EMPTY)
        .when(F.col("total_rows") < S.MIN_ROWS, S.MSG_TOO_FEW)
        .when(F.col("invalid_gender_rows") > 0, F.concat(F.lit(gender_prefix), F.col("invalid_genders")))
        .when(F.col("invalid_numeric_rows") > 0, S.MSG_NUMERIC)
        .when(F.col("age_out_of_range_rows") > 0, S.MSG_AGE)
        .when(F.col("negative_income_rows") > 0, S.MSG_INCOME)
        .when(F.col("score_out_of_range_rows") > 0, S.MSG_SCORE)
    )
    return (agg.withColumn("invalid_genders", F.coalesce(found, F.lit("")))
            .withColumn("message", msg))


def validate(raw: DataFrame) -> DataFrame:
    """Fail-fast form: raise with the reference message, else return the typed table."""
    row = summary(raw).first()
    if row["message"] is not None:
        raise ValidationError(row["message"])
    return typed(normalize(raw))


def quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarantine form: (good typed rows, bad rows with their raw text and reason)."""
    norm = normalize(raw).withColumn("reject_reason", reject_reason())
    good = typed(norm.filter(F.col("reject_reason").isNull()))
    bad = norm.filter(F.col("reject_reason").isNotNull()).select(
        *[F.col(f"{c}_raw").alias(S.PUBLIC_NAMES[c]) for c in S.INTERNAL_COLUMNS], "reject_reason")
    return good, bad


def dataset_health(df: DataFrame) -> DataFrame:
    """Row count, column count and total missing values over all columns.

    A text value is missing if it is NULL or one of the missing-value tokens."""
    missing = None
    for c in df.columns:
        missing_here = C.is_na_token(F.col(f"`{c}`")) if dict(df.dtypes)[c] == "string" else F.col(f"`{c}`").isNull()
        term = F.count_if(missing_here)
        missing = term if missing is None else missing + term
    return df.agg(
        F.count(F.lit(1)).alias("dataset_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("dataset_cols"),
        missing.alias("missing_values"),
    )
