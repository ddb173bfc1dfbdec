"""Request loading: defaults, per-field errors, and the valid/rejected split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import parse_timestamp
from riskloom.schema import FEEDBACK_SCHEMA, REQUEST_DEFAULTS, REQUEST_SCHEMA

# --- fixed values: messages of the range checks ---
AMOUNT_MESSAGE = "amount must be greater than 0."
AGE_MESSAGE = "account_age_days must be >= 0."
FINITE_MESSAGE = "{} must be a finite number."
UTILIZATION_MESSAGE = "credit_utilization must be 0–1."
REQUIRED_MESSAGE = "{} is required."


NULL_MESSAGE = "{} may not be null."
TYPE_MESSAGES = {
    "string": "{} must be text.", "boolean": "{} must be true or false.", "double": "{} must be a number.",
    "bigint": "{} must be a whole number.", "int": "{} must be a whole number.",
}
NULLABLE = {f.name for f in REQUEST_SCHEMA.fields} - set(REQUEST_DEFAULTS) - {"user_id", "amount"}
# --- fixed values: what counts as true and as false ---
TRUE_WORDS = ["t", "T", "true", "True", "TRUE", "on", "On", "ON", "y", "Y", "yes", "Yes", "YES", "1"]
FALSE_WORDS = ["f", "F", "false", "False", "FALSE", "off", "Off", "OFF", "n", "N", "no", "No", "NO", "0"]
FIELD_ERRORS = "field_errors"


def from_json_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to request columns and ``field_errors``, a map of the fields that are there with a wrong value.

    Absent fields come out null without an error, an explicit null has one where the field must have a value. Numbers
    may be written as text; a whole number drops its fraction, but not if it is text. Text that is no JSON object has no fields.
    """
    parsed = df.select(F.try_parse_json(F.col(column)).alias("_v"))
    values = {f.name: _read(f.name, f.dataType) for f in REQUEST_SCHEMA.fields}
    errors = F.map_from_entries(F.array_compact(F.array(*[
        F.when(error.isNotNull(), F.struct(F.lit(n).alias("field"), error.alias("error"))) for n, (_, error) in values.items()
    ])))
    return parsed.select(*[v.alias(n) for n, (v, _) in values.items()], errors.alias(FIELD_ERRORS))


def _read(name: str, kind: T.DataType) -> tuple[Column, Column]:
    """Value and error of one field of the variant ``_v``."""
    path = f"$.{name}"
    found = F.schema_of_variant(F.try_variant_get("_v", path, "variant"))  # null if absent, VOID for an explicit null
    text = F.try_variant_get("_v", path, "string")
    number, string = found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), found == "STRING"
    if isinstance(kind, T.StringType):
        value = F.when(string, text)
    elif isinstance(kind, T.BooleanType):
        numeric = F.try_variant_get("_v", path, "double")
        said = F.when(text.isin(TRUE_WORDS), True).when(text.isin(FALSE_WORDS), False)
        value = F.when(found == "BOOLEAN", F.try_variant_get("_v", path, "boolean")).when(string, said)
        value = value.when(number & numeric.isin(0.0, 1.0), numeric == 1.0)
    elif isinstance(kind, T.DoubleType):
        value = F.when(number | string, F.trim(text).try_cast("double"))
    else:
        digits = F.regexp_replace(F.trim(text), "(?<=\\d)_(?=\\d)", "")
        value = F.when(found == "BIGINT", F.try_variant_get("_v", path, "bigint")).when(number, F.try_variant_get("_v", path, "double").try_cast("bigint"))
        value = value.when(string & digits.rlike("^[+-]?\\d+$"), digits.try_cast("bigint")).try_cast(kind)
    error = F.when((found == "VOID") & F.lit(name not in NULLABLE), NULL_MESSAGE.format(name))
    error = error.when(found.isNotNull() & (found != "VOID") & value.isNull(), TYPE_MESSAGES[kind.simpleString()].format(name))
    if isinstance(kind, T.DoubleType):
        error = error.when(F.isnan(value) | (F.abs(value) == float("inf")), FINITE_MESSAGE.format(name))
    return value, error


def apply_defaults(df: DataFrame) -> DataFrame:
    """Every schema column in order and type; missing or null fields take their default.

    A value that is there but cannot be read as its column's type is an entry of ``field_errors``.
    """
    present = set(df.columns)
    out, wrong = [], []
    for f in REQUEST_SCHEMA.fields:
        value = F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)
        if f.name in present and df.schema[f.name].dataType != f.dataType:
            message = F.lit(TYPE_MESSAGES[f.dataType.simpleString()].format(f.name))
            wrong.append(F.when(F.col(f.name).isNotNull() & value.isNull(), F.struct(F.lit(f.name).alias("field"), message.alias("error"))))
        if f.name in REQUEST_DEFAULTS:
            value = F.coalesce(value, F.lit(REQUEST_DEFAULTS[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    rest = [F.col(c) for c in df.columns if c not in REQUEST_SCHEMA.names and c != FIELD_ERRORS]
    none = F.create_map().cast("map<string,string>")
    errors = F.col(FIELD_ERRORS) if FIELD_ERRORS in present else none
    if wrong:
        errors = F.map_concat(errors, F.map_from_entries(F.array_compact(F.array(*wrong))))
    return df.select(*out, *rest, errors.alias(FIELD_ERRORS))


def request_errors(typed: bool = False) -> Column:
    """Array of messages in the order of the fields, one a field and empty for a valid row. NaN counts as missing.

    ``typed`` says that the rows have ``field_errors``; what is wrong there is not judged further.
    """
    amount, age, use = F.col("amount"), F.col("account_age_days"), F.col("credit_utilization")
    ranges = {
        "user_id": F.when(F.col("user_id").isNull(), REQUIRED_MESSAGE.format("user_id")),
        "amount": F.when(amount.isNull() | F.isnan(amount), REQUIRED_MESSAGE.format("amount")).when(amount <= 0, AMOUNT_MESSAGE)
        .when(amount == float("inf"), FINITE_MESSAGE.format("amount")),
        "account_age_days": F.when(age < 0, AGE_MESSAGE),
        "credit_utilization": F.when(~use.between(0.0, 1.0), UTILIZATION_MESSAGE),
    }
    none = F.lit(None).cast("string")
    checks = [ranges.get(n, none) for n in REQUEST_SCHEMA.names]
    if typed:
        checks = [F.coalesce(F.try_element_at(FIELD_ERRORS, F.lit(n)), c) for n, c in zip(REQUEST_SCHEMA.names, checks)]
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, errors: Column | None = None) -> DataFrame:
    """Add ``errors`` and ``status`` (valid or rejected)."""
    checked = df.withColumn("errors", request_errors(FIELD_ERRORS in df.columns) if errors is None else errors).drop(FIELD_ERRORS)
    return checked.withColumn("status", F.when(F.size("errors") == 0, "valid").otherwise("rejected"))


def split(df: DataFrame, reject_batch: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of validated rows; with ``reject_batch`` one bad row rejects them all."""
    if reject_batch:
        verdict = df.agg(F.coalesce(F.max(F.col("status") == "rejected"), F.lit(False)).alias("_bad"))
        df = df.crossJoin(F.broadcast(verdict))  # a single row
        df = df.withColumn("status", F.when(F.col("_bad"), "rejected").otherwise(F.col("status"))).drop("_bad")
    return df.filter(F.col("status") == "valid"), df.filter(F.col("status") == "rejected")


def to_transactions(requests: DataFrame) -> DataFrame:
    """Valid requests as transactions: the text timestamp parsed into ``ts``."""
    rest = [c for c in requests.columns if c not in ("timestamp", "errors", "status")]
    return requests.select(*rest, parse_timestamp(F.col("timestamp")).alias("ts"))


def outcome_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count("*").alias("requests"))


def feedback_records(df: DataFrame) -> DataFrame:
    """Validated feedback rows with a request id and the UTC time of logging."""
    required = ["transaction_id", "predicted_tier", "actual_label"]
    present = set(df.columns)
    typed = df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in FEEDBACK_SCHEMA.fields
        ]
    )
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), REQUIRED_MESSAGE.format(c)) for c in required]), lambda m: m.isNotNull()
    )
    return validate(typed, missing).withColumns(
        {
            "request_id": F.uuid(),
            "logged_at": F.date_format(
                F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
            ),
        }
    )


FEEDBACK_LOG_SCHEMA = T.StructType(
    [*FEEDBACK_SCHEMA.fields, T.StructField("request_id", T.StringType()), T.StructField("logged_at", T.StringType())]
)
