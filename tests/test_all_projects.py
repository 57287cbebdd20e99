"""The search over all projects takes its hits by project alone."""

import pytest
from factloom.plans.engine import CodeIndex


@pytest.mark.parametrize("query", ["order", "*", "a-b%"])
def test_no_cut_before_the_window(spark, tmp_path, query):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "Order.java").write_text("class Order { void order() {} }")
    index = CodeIndex(spark, str(tmp_path / "store"), {n: str(tmp_path / n) for n in ("one", "two")})
    index.reindex()
    found = index.search_all_projects(query, 2)
    assert "GlobalLimit" not in found._jdf.queryExecution().optimizedPlan().toString()
    if query != "a-b%":
        counts = {r["project"]: r["count"] for r in found.groupBy("project").count().collect()}
        assert counts == {"one": 2, "two": 2}
