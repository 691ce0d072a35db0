"""Parts are counted before they meet the table of states, so that no task gets all parts of a state."""

from logloom.operators import eligibility


def test_only_counts_are_joined(spark):
    plan = eligibility.q_state_flags(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    at = [next(i for i, line in enumerate(lines) if line.startswith(k)) for k in ("Join", "Aggregate")]
    assert at[0] < at[1], plan
