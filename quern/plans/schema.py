"""The driver's relational tables as declared tables."""

from quern.operators.tables import Table, datetime_field, double_field, int_field, str_field

NATION = Table("nation", int_field("n_nationkey"), str_field("n_name"), int_field("n_regionkey"))
REGION = Table("region", int_field("r_regionkey"), str_field("r_name"))
CUSTOMER = Table("customer", int_field("c_custkey"), str_field("c_name"), int_field("c_nationkey"), double_field("c_acctbal"), str_field("c_mktsegment"))
SUPPLIER = Table("supplier", int_field("s_suppkey"), str_field("s_name"), int_field("s_nationkey"), double_field("s_acctbal"))
PART = Table("part", int_field("p_partkey"), str_field("p_name"), str_field("p_brand"), str_field("p_type"), int_field("p_size"), double_field("p_retailprice"))
ORDERS = Table("orders", int_field("o_orderkey"), int_field("o_custkey"), str_field("o_orderstatus"), double_field("o_totalprice"), datetime_field("o_orderdate"), str_field("o_orderpriority"))
LINEITEM = Table(
    "lineitem", int_field("l_orderkey"), int_field("l_partkey"), int_field("l_suppkey"), int_field("l_linenumber"), double_field("l_quantity"), double_field("l_extendedprice"),
    double_field("l_discount"), double_field("l_tax"), str_field("l_returnflag"), str_field("l_linestatus"), datetime_field("l_shipdate"),
)
EVENTS = Table("events", int_field("event_id"), datetime_field("ts"), int_field("user_id"), str_field("event_type"), double_field("value"), str_field("props"))
