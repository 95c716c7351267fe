import pytest
from pyspark.sql import functions as F

from relata.operators.filters import FilterSyntaxError, parse_filters, to_ast
from relata.plans.list_query import ListQuery
from relata.sources.tables import driver_catalog

from conftest import SF_SMALL


def test_parse_items_and_groups():
    toks = parse_filters("a = 1,|,[,b in x;y,*,!,c ~ été,]")
    assert toks[0] == {"field": "a", "type": "=", "value": "1"}
    assert toks[1] == "|"
    assert toks[2][0] == {"field": "b", "type": "in", "value": ["x", "y"]}
    assert toks[2][3] == {"field": "c", "type": "~", "value": "été"}


def test_operator_choice_earliest_then_longest():
    assert parse_filters("a >= 3")[0]["type"] == ">="
    assert parse_filters("name like a = b")[0] == {"field": "name", "type": "like", "value": "a = b"}
    assert parse_filters("rel any")[0] == {"field": "rel", "type": "any", "value": ""}
    assert parse_filters("has_rel")[0] == {"field": "rel", "type": "any"}


def test_left_associative_no_precedence():
    ast = to_ast("a = 1,|,b = 2,*,c = 3")
    assert ast[0] == "and" and ast[1][0] == "or"


def test_double_negation_cancels():
    ast = to_ast("!,!,a = 1")
    assert ast[0] == "atom"


@pytest.mark.parametrize("bad", ["a = 1,]", "[,a = 1", "a 1", "a = 1,|,|,b = 2", "a = 1,|", ""])
def test_syntax_errors(bad):
    with pytest.raises(FilterSyntaxError):
        if bad == "":
            parse_filters(",")
        else:
            to_ast(bad)


def test_row_matching_rule_negation(cat):
    # '! lineitems.l_returnflag = R' keeps an order having any line with another flag
    q = ListQuery(cat, "order", fields=["o_orderkey"], filters="!,lineitems.l_returnflag = R")
    got = {r.o_orderkey for r in q.build().collect()}
    li = cat.frame("lineitem")
    exp = {r.l_orderkey for r in li.filter(F.col("l_returnflag") != "R").select("l_orderkey").distinct().collect()}
    assert got == exp


def test_same_joined_row(cat):
    q = ListQuery(cat, "order", fields=["o_orderkey"], filters="lineitems.l_returnflag = R,lineitems.l_quantity > 45")
    got = {r.o_orderkey for r in q.build().collect()}
    li = cat.frame("lineitem")
    exp = {r.l_orderkey for r in li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).collect()}
    assert got == exp


def test_semi_and_anti_partition_all(cat):
    a = ListQuery(cat, "order", fields=["o_orderkey"], filters="lineitems any").build().count()
    b = ListQuery(cat, "order", fields=["o_orderkey"], filters="!,lineitems any").build().count()
    assert a + b == cat.frame("order").count()


def test_two_to_many_relations_do_not_multiply(cat):
    # OR across two relations: exact, and each object once
    q = ListQuery(cat, "customer", fields=["c_custkey"], filters="orders.o_totalprice > 450000,|,events.event_type = error")
    rows = [r.c_custkey for r in q.build().collect()]
    assert len(rows) == len(set(rows))
    o = {r.o_custkey for r in cat.frame("order").filter(F.col("o_totalprice") > 450000).collect()}
    e = {r.user_id for r in cat.frame("event").filter(F.col("event_type") == "error").collect()}
    assert set(rows) == (o | e)


def test_info_counts(cat):
    q = ListQuery(cat, "customer", prefilters="c_mktsegment = BUILDING", filters="c_acctbal > 5000", page_size=7)
    r = q.info().collect()[0]
    c = cat.frame("customer")
    total = c.filter(F.col("c_mktsegment") == "BUILDING").count()
    filt = c.filter((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000)).count()
    assert (r.total, r.filtered) == (total, filt)
    assert r.last_page == -(-total // 7)


@pytest.mark.parametrize("spec, where", [
    ("!,customers.orders.o_totalprice > 30000,customers.events.event_type = error", "NOT o_totalprice > 30000 AND event_type = 'error'"),
    ("customers.orders.o_totalprice > 400000,|,customers.events.value > 300", "o_totalprice > 400000 OR value > 300"),
    ("customers.orders.lineitems.l_quantity > 49,customers.events.value > 200,customers.c_acctbal > 5000",
     "l_quantity > 49 AND value > 200 AND c_acctbal > 5000"),
    ([{"field": "customers.orders.o_orderkey", "type": "=", "value": None}, {"field": "customers.events.value", "type": ">", "value": "250"}],
     "o_orderkey IS NULL AND value > 250"),
])
def test_sibling_branches_equal_joined_rows(spark, spec, where):
    cat = driver_catalog(spark, SF_SMALL)  # a third of the customers are without orders
    cat.set_frame("order", cat.frame("order").filter("o_custkey % 3 <> 0"))
    n, c, o, e, li = (cat.frame(t) for t in ("nation", "customer", "order", "event", "lineitem"))
    rows = (n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(e, F.col("user_id") == F.col("c_custkey"), "left"))
    if "l_quantity" in where:
        rows = rows.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    want = {r.n_nationkey for r in rows.filter(where).select("n_nationkey").distinct().collect()}
    got = [r.n_nationkey for r in ListQuery(cat, "nation", fields=["n_nationkey"], filters=spec).build().collect()]
    assert sorted(got) == sorted(want) and 0 < len(want)
