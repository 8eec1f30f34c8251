"""Plans in which a table that grows with the input must not be collected by the driver."""

import pytest

from skyquad.operators import matching
from skyquad.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["image_noise", "resized_pixels", "detected_sources", "rendered_field", "detection_metrics"])
def test_no_pixels_are_broadcast(spark, name):
    """Pixels are many times the rows that they are made from, by whose size they would be broadcast."""
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["nearest_neighbours", "one_to_one_matches", "match_error"])
def test_no_places_are_broadcast(spark, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, SF))


def test_pairs_of_lists_are_made_in_blocks(spark):
    """Both lists are cut before pairs are made, so that what a task holds does not grow with them; they are shuffled as plain values, nulls too."""
    s = lambda n, m: ", ".join(f"struct({f'cast({i} as bigint)' if i != 5 else 'cast(null as bigint)'} as v)" for i in range(n, n + m))
    hit = spark.sql(f"select 7 as d2, array({s(0, 150)}) as id, array({s(3, 70)}) as other union all select 8, array({s(9, 1)}), array({s(5, 1)})")
    out = matching.expanded(hit, "id", "other")
    told = plan(out)
    assert told.count("explode(transform(") == 2 and told.split("Exchange")[0].count(".v AS") == 0
    v = lambda n, m: [None if i == 5 else i for i in range(n, n + m)]
    want = [(7, a, b) for a in v(0, 150) for b in v(3, 70)] + [(8, 9, None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
