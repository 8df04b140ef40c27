"""The reports under session settings a cluster may have."""

import pytest

import finstat
from finstat.session import shared_folder
from tests.conftest import ordered, rows

REPORTS = ["pl_one_year", "pl_yoy", "bs_yoy", "accounting_equation", "bs_by_account", "section_totals", "line_count"]


@pytest.mark.parametrize(
    "options",
    [
        {"spark__sql__ansi__enabled": "false"},
        {"spark__sql__adaptive__enabled": "false", "spark__sql__autoBroadcastJoinThreshold": "-1"},
        {"spark__sql__codegen__wholeStage": "false"},
        {"spark__sql__session__timeZone": "Pacific/Auckland"},
    ],
)
def test_results_do_not_depend_on_settings(micro, conf, options):
    expected = {name: ordered(rows(getattr(finstat, name)(micro, 2016))) for name in REPORTS}
    conf(**options)
    for name in REPORTS:
        assert ordered(rows(getattr(finstat, name)(micro, 2016))) == expected[name], name
    parts = finstat.financial_statements(micro, 2016)
    assert ordered(rows(parts.balance_sheet)) == expected["bs_yoy"]


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_its_shared_folder(master):
    class Conf:
        def get(self, key, default):
            return {"spark.master": master}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        shared_folder(Session())
