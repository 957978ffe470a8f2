"""Every registered query equals its SQL on the smallest tables, and plans stay as intended."""

import re

import pytest
from check_queries import compare, connect, entry_module
from hashloom.operators import skew
from hashloom.suite import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name) in (None, "EMPTY")


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_module.queries()) and set(QUERIES) <= set(entry_module.oracle_sql())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """Plan as if no table were small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("pred", "resolve", "collapse", "group"))])
def test_no_cross_products(large, name):
    plan = plan_of(QUERIES[name](large, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(large):
    plan = plan_of(QUERIES["pred_one_eq"](large, SF_DIR))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan
    plan = plan_of(QUERIES["pred_many_eq"](large, SF_DIR))
    assert "EqualTo(l_returnflag,R)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan


def test_one_aggregation_for_many_conditions(large):
    plan = plan_of(QUERIES["pred_bool_tree_one_scan"](large, SF_DIR))
    assert len(re.findall("FileScan", plan)) == 2 and len(re.findall("Exchange", plan)) == 2


def test_single_valued_queries_do_not_shuffle(large):
    for name in ("pred_all", "resolve", "default_fill", "pred_term_one", "add_feature"):
        assert "Exchange" not in plan_of(QUERIES[name](large, SF_DIR))


@pytest.mark.parametrize(
    "name",
    [
        "resolve_two_multi_rows",
        "resolve_cross_context",
        "resolve_cross_context_backwards",
        "group_by_feature_many_values",
        "join_on_many_key",
        "pred_term_neq_many",
        "equivalence_class_members",
        "reset_one_by_frames",
        "reset_many",
        "delete_entities",
    ],
)
def test_query_equals_sql_with_hot_keys(spark, connection, name, monkeypatch):
    """The same with every key of more than two rows salted."""
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    assert compare(spark, connection, SF_DIR, name) is None
