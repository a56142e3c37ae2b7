"""Message envelopes ``event_type, schema_version, payload`` (A2, A9); batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1"


def read_envelopes(
    envelopes: DataFrame, schema: T.StructType | str, event_type: str | None = None, required: Sequence[str] = ()
) -> DataFrame:
    """A2: payloads as typed columns, with ``error`` where one is missing or malformed.

    A value of another type than the schema's, and a field of ``required`` that is absent or
    null, are errors too; then all fields are NULL.  Keeps the other columns of the envelope.
    ``event_type`` selects one kind.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*schema.fields, T.StructField("__raw", T.StringType())])
    rows = envelopes if event_type is None else envelopes.where(F.col("event_type") == event_type)
    parsed = rows.withColumn("__m", F.from_json("payload", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__raw"}))
    usable = F.try_parse_json("payload")
    error = F.when(F.col("payload").isNull(), F.lit("message does not contain payload")).when(
        usable.isNull() | ~F.startswith(F.schema_of_variant(usable), F.lit("OBJECT")), F.lit("payload is not a JSON object")
    ).when(F.col("__m.__raw").isNotNull(), F.lit("payload does not match the schema"))
    for name in required:
        error = error.when(F.col(f"__m.{name}").isNull(), F.lit(f"payload lacks {name}"))
    keep = [c for c in envelopes.columns if c not in ("payload", "schema_version")]
    inner = schema.names
    keep = [c for c in keep if c not in inner]
    parsed = parsed.withColumn("__error", error)
    fields = [F.when(F.col("__error").isNull(), F.col(f"__m.{n}")).alias(n) for n in inner]
    return parsed.select(*keep, *fields, F.col("__error").alias("error"))


def emit_envelopes(rows: DataFrame, event_type: str) -> DataFrame:
    """Typed rows as envelopes."""
    return rows.select(
        F.lit(event_type).alias("event_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.to_json(F.struct("*")).alias("payload"),
    )
