"""Queries over the line items as air take the whole table, which their SQL cuts to every tenth order."""

import pytest
from compare import connect, same

from nimbogrid.plans import ORACLES, QUERIES

CUT = " WHERE l_orderkey % 10 = 0"
WITH_SQL = ["relative_humidity", "adjust_pressure", "state_to_physical", "saturation", "dew_point", "potential_temperatures", "reflectivity_methods", "radial_velocity"]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql_over_all_line_items(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLES[name].replace(CUT, ""))


@pytest.mark.parametrize("name", ["reflectivity_melting", "radar_operator"])
def test_has_all_line_items(spark, sf, con, name):
    want = con.sql("SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice FROM lineitem)").fetchall()[0][0]
    assert QUERIES[name](spark, sf).count() == want
