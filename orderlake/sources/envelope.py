"""The change log's envelope: key and value bytes and a topic. A value is a header of five bytes (a zero, then the schema's
number) and the payload, a JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from orderlake.sources.contracts import BRONZE, SILVER, Contract

HEADER, CORRUPT = 5, "_corrupt_record"


def composite_key(columns: list[str], sep: str = "-") -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])


def encode(df: DataFrame, topic: str, key: list[str], schema_id: int = 1) -> DataFrame:
    """key, value, topic of every row; the key's columns aren't in the value."""
    payload = F.to_json(F.struct(*[c for c in df.columns if c not in key]), {"ignoreNullFields": "false"})
    header = F.unhex(F.lit(f"{0:02x}{schema_id:08x}"))
    return df.select(composite_key(key).cast("binary").alias("key"), F.concat(header, payload.cast("binary")).alias("value"), F.lit(topic).alias("topic"))


def decode(log: DataFrame, topic: str, contract: Contract) -> DataFrame:
    """One topic's rows in the contract's columns, key last. A payload that isn't as declared has nulls, and its text in
    ``_corrupt_record``."""
    schema = T.StructType([*contract.value_schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    body = F.substring("value", HEADER + 1, 2**31 - 1 - HEADER).cast("string")
    rows = log.where(F.col("topic") == topic).select(F.col("key").cast("string").alias("__key"), F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("data"))
    parts = F.split("__key", "-")
    keys = [(F.col("__key") if len(contract.key) == 1 else parts[i]).cast(t).alias(n) for i, (n, t) in enumerate(contract.key)]
    return rows.select("data.*", *keys)


def contract_of(topic: str) -> Contract:
    """The contract of a topic by its last name: layer, then table."""
    layer, _, name = topic.partition(".")
    return {"bronze": BRONZE, "silver": SILVER}[layer][name.rpartition(".")[2]]
