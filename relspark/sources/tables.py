"""The test tables as relations: money in cents, times in microseconds, intervals as two columns."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relspark.engine import Frames, Instance
from relspark.schema import Capacity, Contained, Key, Schema, closed, relation, side
from relspark.types import I64, U64, Bool, Interval, Str

HOUR = 3_600_000_000

#: The event types in the tables, in order of name, and which of them are of money or trouble.
EVENT_TYPES = {"click": (False,), "error": (False,), "purchase": (True,), "signup": (True,), "view": (False,)}

SCHEMA = Schema(
    (
        relation("Region", id=I64(), name=Str()),
        relation("Nation", id=I64(), name=Str(), region=I64()),
        relation("Customer", id=I64(), nation=I64(), segment=Str(), balance=I64()),
        relation("Supplier", id=I64(), nation=I64(), balance=I64()),
        relation("Part", id=I64(), brand=Str(), kind=Str(), size=I64(), price=I64()),
        relation("Order", id=I64(), cust=I64(), status=Str(), total=I64(), placed=I64()),
        relation("Line", order=I64(), part=I64(), supp=I64(), line=I64(), qty=I64(), price=I64(), ship=I64()),
        relation("Event", id=I64(), user=I64(), type=U64(), value=I64(), at=I64()),
        relation("EventSpan", user=I64(), type=U64(), during=Interval(I64(), HOUR)),
        relation("Shipment", order=I64(), line=I64(), part=I64(), during=Interval(I64())),
        relation("Turn", conv=I64(), turn=I64(), role=Str()),
        relation("Next", node=I64(), after=I64()),
        relation("Follow", src=I64(), dst=I64(), weight=I64()),
        closed("EventType", EVENT_TYPES, valued=Bool()),
    ),
    (
        *(Key(n, ("id",)) for n in ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Event")),
        Contained(side("Nation", "region"), side("Region", "id")),
        Contained(side("Customer", "nation"), side("Nation", "id")),
        Contained(side("Supplier", "nation"), side("Nation", "id")),
        Contained(side("Order", "cust"), side("Customer", "id")),
        Contained(side("Line", "order"), side("Order", "id")),
        Contained(side("Event", "type"), side("EventType", "id")),
        Contained(side("EventSpan", "type"), side("EventType", "id")),
    ),
)

#: Statements that the tables break, to judge by.
JUDGED = Schema(
    SCHEMA.relations,
    (
        *(s for s in SCHEMA.statements if isinstance(s, Key)),
        Key("Line", ("order", "line")),
        Key("EventSpan", ("user", "during")),
        Contained(side("Line", "part", qty=1), side("Part", "id")),
        Contained(side("Order", "cust"), side("Customer", "id")),
        Capacity(side("Order", "id"), side("Line", "order"), 1, 6),
        Capacity(side("Customer", "id"), side("Order", "cust"), 0, 2_000_000_000, weight="total"),
    ),
)


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    def t(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def event():
        kinds = F.create_map(*(F.lit(x) for i, k in enumerate(EVENT_TYPES) for x in (k, i)))
        return t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.element_at(kinds, F.col("event_type")).alias("type"), cents("value").alias("value"), micros("ts").alias("at"))

    def line():
        return t("lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("qty"), cents("l_extendedprice").alias("price"), micros("l_shipdate").alias("ship"))

    def order():
        return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), cents("o_totalprice").alias("total"), micros("o_orderdate").alias("placed"))

    def shipment():
        ships = line().join(order().select(F.col("id").alias("order"), "placed"), "order").where("placed < ship")
        return ships.select("order", "line", "part", F.col("placed").alias("during_start"), F.col("ship").alias("during_end"))

    def following():
        node = F.col("conv_id") * 1000 + F.col("turn")
        return t("conversations").where("turn > 0").select((node - 1).alias("node"), node.alias("after"))

    def follow():
        here = line().select("order", F.col("line") + 1, F.col("part").alias("src")).toDF("order", "line", "src")
        return here.join(line(), ["order", "line"]).select("src", F.col("part").alias("dst"), F.col("qty").alias("weight"))

    return Frames(
        {
            "Region": lambda: t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
            "Nation": lambda: t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")),
            "Customer": lambda: t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), cents("c_acctbal").alias("balance")),
            "Supplier": lambda: t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), cents("s_acctbal").alias("balance")),
            "Part": lambda: t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), cents("p_retailprice").alias("price")),
            "Order": order,
            "Line": line,
            "Event": event,
            "EventSpan": lambda: event().select("user", "type", F.col("at").alias("during_start")),
            "Shipment": shipment,
            "Turn": lambda: t("conversations").select(F.col("conv_id").alias("conv"), "turn", "role"),
            "Next": following,
            "Follow": follow,
        }
    )


#: Relations whose rows the tables keep distinct.
SETS = {"Region", "Nation", "Customer", "Supplier", "Part", "Order", "Event"}


def load(spark: SparkSession, sf_dir: str, schema: Schema = SCHEMA) -> Instance:
    """The tables keep the statements of ``SCHEMA`` (a test judges them); under others nothing is known of them."""
    return Instance(spark, schema, frames(spark, sf_dir), sets=SETS, admitted=schema is SCHEMA)
