"""Declared schemas of the tables: columns and key columns. Silver and gold columns are not null, but for the lead-days fact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


@dataclass(frozen=True)
class Contract:
    """A table's value columns and its key. The key stands last and is never null, as a log carries it outside its values."""

    name: str
    values: tuple[tuple[str, T.DataType], ...]
    key: tuple[tuple[str, T.DataType], ...] = ()
    nullable: bool = True

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*[T.StructField(n, t, self.nullable) for n, t in self.values], *[T.StructField(n, t, False) for n, t in self.key]])

    @property
    def value_schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, True) for n, t in self.values])

    @property
    def key_names(self) -> list[str]:
        return [n for n, _ in self.key]


def contract(name: str, key: dict, values: dict, nullable: bool = True) -> Contract:
    return Contract(name, tuple(values.items()), tuple(key.items()), nullable)


BRONZE = {
    c.name: c
    for c in (
        contract("customer", {"customer_id": S}, {"zip_code": I}),
        contract("seller", {"seller_id": S}, {"zip_code": I}),
        contract("geolocation", {"zip_code": I}, {"lat": D, "lng": D, "state": S, "city": S}),
        contract("product", {"product_id": S}, {"category": S, "weight_g": D, "length_cm": D, "height_cm": D, "width_cm": D}),
        contract("order_item", {"order_id": S}, {"order_item_id": I, "shipping_limit_date": TS, "price": D, "freight_value": D, "product_id": S, "seller_id": S}),
        contract("order_status", {"order_id": S}, {"status": S, "timestamp": TS}),
        contract("estimated_delivery_date", {"order_id": S}, {"estimated_delivery_date": TS}),
        contract("payment", {"order_id": S}, {"payment_sequential": I, "timestamp": TS, "payment_value": D, "payment_type": S, "payment_installments": I, "customer_id": S}),
        contract("review", {"review_id": S}, {"order_id": S, "review_creation_date": TS, "review_answer_timestamp": TS, "review_score": I, "review_comment_title": S, "review_comment_message": S}),
    )
}
SILVER = {
    c.name: c
    for c in (
        contract("geo_coord", {"zip_code": I}, {"lat": D, "lng": D}, False),
        contract("user", {"user_type": S, "user_id": S}, {"zip_code": I}, False),
        contract("order_event", {"order_id": S, "data_type": S, "timestamp": TS}, {}, False),
        contract("product_metadata", {"product_id": S, "seller_id": S}, {"category": S}, False),
        contract("customer_order", {"order_id": S, "product_id": S, "customer_id": S, "seller_id": S}, {"quantity": L, "unit_price": D}, False),
        contract("review_metadata", {"review_id": S}, {"order_id": S, "review_creation_date": TS, "review_answer_timestamp": TS, "review_score": I}, False),
        contract("watermark", {"app_name": S, "src": S}, {"last_processed_snapshot_id": L}, False),
    )
}


def project(df: DataFrame, c: Contract) -> DataFrame:
    """The frame in a contract's shape: its columns in order and of its types, rows without key left out."""
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in c.schema])
    return rows.dropna(subset=c.key_names) if c.key else rows
