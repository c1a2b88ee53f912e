"""C7 searches a text once and not again for each end of the range."""

from mnemolake.plans import registry
from tests.harness import differences

registry.load()


def test_days_are_found_before_they_are_filtered(spark, sf):
    df = registry.QUERIES["c7_records_about"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not differences(df, registry.ORACLES["c7_records_about"], sf)
    assert "content" not in plan, plan
