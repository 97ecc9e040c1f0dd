"""Every query of decoded pages over orders: its rows come from tasks, none of them by way of the driver."""

import pytest

from colscan import catalogue

NAMES = sorted(n for n in catalogue.queries() if n.startswith("pages_") and n != "pages_of_lists")


@pytest.mark.parametrize("name", NAMES)
def test_no_join_and_no_broadcast(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
