"""Inputs: JSON text, state lines, serialised fields, checks, fact words."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.operators import inputs as I
from arbitra.plans.base import query, table

# JSON objects of mixed types made from the orders table.
_ORDER_JSON = (
    "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, o_orderkey % 7 = 0 AS no_status FROM orders"
)


def _order_json(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))
    obj = F.struct(
        status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust"),
        (F.col("o_orderkey") % 2 == 0).alias("even"), F.array(F.lit(1), F.col("o_custkey")).alias("list"),
    )
    return o.select("o_orderkey", F.to_json(obj, {"ignoreNullFields": "false"}).alias("js"), "o_orderpriority")


@query(
    "extract_text",
    f"SELECT o_orderkey, o_orderpriority || CASE WHEN no_status THEN '' ELSE ' ' || o_orderstatus END AS text FROM ({_ORDER_JSON})",
)
def extract_text(spark, sf):
    return I.with_text(_order_json(spark, sf), "js").select("o_orderkey", "text")


@query(
    "extract_text_events",
    "SELECT event_id, '' AS from_object, props->>'k' AS from_number, event_type AS from_string FROM events",
)
def extract_text_events(spark, sf):
    e = table(spark, sf, "events").withColumn("num", F.get_json_object("props", "$.k"))
    e = e.withColumn("str", F.concat(F.lit('"'), "event_type", F.lit('"')))
    a = I.with_text(e, "props", "from_object").drop("error")
    b = I.with_text(a, "num", "from_number").drop("error")
    return I.with_text(b, "str", "from_string").select("event_id", "from_object", "from_number", "from_string")


@query(
    "render_state",
    "SELECT o_orderkey, 'cust: ' || o_custkey || chr(10) || 'even: ' || (o_orderkey % 2 = 0) || chr(10) || "
    "'list: [1,' || o_custkey || ']' || chr(10) || 'priority: ' || o_orderpriority || "
    f"CASE WHEN no_status THEN '' ELSE chr(10) || 'status: ' || o_orderstatus END AS state_text FROM ({_ORDER_JSON})",
)
def render_state(spark, sf):
    return I.with_state(_order_json(spark, sf), "js").select("o_orderkey", "state_text")


@query(
    "compose_input",
    "SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL WHEN event_id % 5 = 4 THEN 'k: ' || (props->>'k') "
    "WHEN event_id % 5 = 2 THEN event_type ELSE 'k: ' || (props->>'k') || chr(10) || event_type END AS composed, "
    "CASE WHEN event_id % 5 = 3 THEN 'state must be an object' END AS error FROM events",
)
def compose_input(spark, sf):
    e = table(spark, sf, "events")
    case = F.col("event_id") % 5
    e = e.withColumn("inp", F.when(case == 4, F.lit(None)).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))))
    e = e.withColumn("st", F.when(case == 2, F.lit(None)).when(case == 3, F.lit("[1]")).otherwise(F.col("props")))
    return I.compose_input(e, "inp", "st").select("event_id", "composed", "error")


_FIELDS = [("from", "role"), ("subject", "turn"), ("body", "text")]


@query(
    "serialize_fields",
    "SELECT conv_id, turn, 'from: ' || role || ' subject: ' || turn || ' body: ' || text AS serialized FROM conversations",
)
def serialize_fields(spark, sf):
    return I.serialize_fields(table(spark, sf, "conversations"), _FIELDS, "serialized").select("conv_id", "turn", "serialized")


@query(
    "parse_fields",
    "SELECT conv_id, turn, role AS \"from\", CAST(turn AS VARCHAR) AS subject, text AS body, 'none' AS cc FROM conversations",
)
def parse_fields(spark, sf):
    s = I.serialize_fields(table(spark, sf, "conversations"), _FIELDS, "serialized").select("conv_id", "turn", "serialized")
    s = I.parse_fields(s, "serialized", ["from", "subject", "body"])
    return s.withColumn("cc", I.field_value("serialized", "cc", None, "none")).drop("serialized")


@query(
    "validate_examples",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'missing field \"input\"' WHEN event_id % 4 = 1 THEN '\"label\" must be a string' END AS error, "
    "CASE WHEN event_id % 4 > 1 THEN event_type END AS input, CASE WHEN event_id % 4 > 1 THEN 'x' END AS label FROM events",
)
def validate_examples(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("input"),
        F.when(F.col("event_id") % 4 == 1, F.lit("3")).otherwise(F.lit('"x"')).alias("label"),
    )
    good, bad = I.validate_examples(e)
    null = F.lit(None).cast("string")
    return good.withColumn("error", null).unionByName(bad.select("event_id", "error", null.alias("input"), null.alias("label")))


@query(
    "validate_policies",
    "SELECT event_id, CASE WHEN a > 1 THEN 'act_above must be in [0,1]' WHEN l > 1 THEN 'review_low must be in [0,1]' "
    "WHEN l > h THEN 'review_low must be <= review_high' WHEN h > a THEN 'review_high must be <= act_above' END AS error "
    "FROM (SELECT event_id, (event_id % 11) / 9.0 AS a, (event_id % 13) / 11.0 AS l, (event_id % 5) / 5.0 AS h FROM events)",
)
def validate_policies(spark, sf):
    i = F.col("event_id")
    p = table(spark, sf, "events").select(
        "event_id", ((i % 11) / 9.0).alias("act_above"), ((i % 13) / 11.0).alias("review_low"),
        ((i % 5) / 5.0).alias("review_high"), F.col("value").alias("abstain_energy_above"),
    )
    return I.validate_policies(p).select("event_id", "error")


@query(
    "tokenize_facts",
    "SELECT l_orderkey, l_linenumber, l_partkey, 'q_' || CASE WHEN d < 0 THEN 'n' || abs(d) WHEN d > 0 THEN 'p' || d ELSE 'zero' END || ' line_' || "
    "CASE WHEN l_linenumber <= 2 THEN 'C' WHEN l_linenumber <= 6 THEN 'M' ELSE 'F' END || ' qty_' || "
    "CASE WHEN l_quantity <= 15 THEN 'T' WHEN l_quantity <= 50 THEN 'R' ELSE 'O' END || ' flag_' || l_returnflag AS facts "
    "FROM (SELECT *, CAST(l_quantity - 25 AS BIGINT) AS d FROM lineitem)",
)
def tokenize_facts(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("d", (F.col("l_quantity") - 25).cast("bigint"))
    specs = [("q", "d", "signed"), ("line", "l_linenumber", "distance"), ("qty", "l_quantity", "space"), ("flag", "l_returnflag", "plain")]
    return I.tokenize_facts(li, specs).select("l_orderkey", "l_linenumber", "l_partkey", "facts")
