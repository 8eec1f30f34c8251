"""Every query against its SQL, and those without SQL for their rows."""

import pytest

from skyquad.plans import registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.SQL[name], SF)


def test_solves_its_fields(spark):
    found = {r["frame_id"]: r for r in registry.flagship(spark, SF).collect()}
    for i, (ra, dec) in enumerate(((5.0, 25.0), (15.0, 25.5), (6.0, 24.5))):
        assert found[i]["success"], found[i]
        assert abs(found[i]["ra_deg"] - ra) < 0.01 and abs(found[i]["dec_deg"] - dec) < 0.01


def test_detector_finds_rendered_stars(spark):
    for r in registry.QUERIES["detection_metrics"](spark, SF).collect():
        assert r["match_rate"] >= 0.9 and r["close"]
