import datetime

import pytest

from strideline.operators import enhanced


def assignments(spark, **junctions):
    """Counts by branch for each junction j0, j1, ...; a branch under 0 stands for no branch."""
    rows = [(f"{j}-{b}-{k}", int(j[1:]), b) for j, counts in junctions.items() for b, n in counts.items() for k in range(n)]
    return spark.createDataFrame(rows, "trajectory string, junction int, branch int")


@pytest.mark.parametrize(("n", "crowding"), [(49, 0.0), (50, 0.0), (51, 0.02), (60, 0.2), (75, 0.5), (100, 1.0), (101, 1.0), (200, 1.0)])
def test_crowding_begins_at_fifty(spark, n, crowding):
    third = n // 3
    row = enhanced.risk(assignments(spark, j0={0: third, 1: third, 2: n - 2 * third})).first()
    assert row["crowding"] == pytest.approx(crowding) and row["risk"] == pytest.approx(crowding / 3)


def test_risk_levels(spark):
    a = assignments(spark, j0={0: 120}, j1={0: 45, 1: 5}, j2={-1: 3}, j3={0: 1, 1: 1, 2: 1})
    found = {r["junction"]: r for r in enhanced.risk(a).collect()}
    assert found[0]["risk"] == pytest.approx(1.0) and found[0]["level"] == "HIGH"
    assert found[1]["risk"] == pytest.approx((0.2 / 0.3 + 0.3) / 3) and found[1]["level"] == "LOW"
    assert found[2]["risk"] == pytest.approx(1 / 3) and found[2]["routes"] == found[2]["total"] == 0
    assert found[3]["risk"] == 0
    assert {r["junction"] for r in enhanced.risk(a, least=0.4).collect()} == {0}
    assert enhanced.overall_risk(a).first()["risk"] == pytest.approx((1 + (0.2 / 0.3 + 0.3) / 3 + 1 / 3) / 4)


def test_efficiency_is_the_evenness_of_routes(spark):
    a = assignments(spark, j0={0: 10, 1: 10}, j1={0: 150}, j2={0: 3, 1: 1, -2: 9})
    found = {r["junction"]: (r["route_efficiency"], r["capacity"]) for r in enhanced.efficiency(a).collect()}
    assert found == {0: (pytest.approx(1.0), 0.2), 1: (0.0, 1.0), 2: (pytest.approx(0.8112781), 0.04)}
    assert enhanced.overall_efficiency(a).first()["efficiency"] == pytest.approx((1 + 0.8112781) / 3)


def test_bottlenecks_and_recommendations(spark):
    a = assignments(spark, j0={0: 9, 1: 1}, j1={2: 7, 0: 3}, j2={0: 5, 1: 5}, j3={-1: 4})
    assert {(r["junction"], r["branch"], r["severity"]) for r in enhanced.bottlenecks(a).collect()} == {(0, 0, "HIGH"), (1, 2, "MEDIUM")}
    said = {(r["type"], r["priority"], r["junction"]): r["message"] for r in enhanced.recommendations(a).collect()}
    assert set(said) == {("Signage", "HIGH", "0"), ("Route Modification", "HIGH", "0"), ("Maintenance", "LOW", "1"), ("Maintenance", "LOW", "2")}
    assert "Branch 0 (currently 90.0% of traffic)" in said["Signage", "HIGH", "0"] and "(balance ratio: 1.00)" in said["Maintenance", "LOW", "2"]
    most = enhanced.recommendations(a.where("junction < 3"))
    assert most.where("junction = 'ALL'").select("type", "priority").first() == ("System-wide", "MEDIUM")
    at = datetime.datetime(2024, 1, 1)
    row = enhanced.overview(a, at=at).first()
    assert (row["bottlenecks"], row["balanced"], row["recommendations"], row["at_risk"], row["analysed_at"]) == (2, 2, 4, 0, at)
    assert {(r["junction"], r["total"]) for r in enhanced.flow_analysis(a).collect()} == {(0, 10), (1, 10), (2, 10), (3, 0)}


def test_no_rows(spark):
    a = assignments(spark, j0={0: 1}).limit(0)
    assert enhanced.risk(a).count() == enhanced.bottlenecks(a).count() == enhanced.recommendations(a).count() == 0
    assert enhanced.overall_risk(a).first()["risk"] is None


def test_overall_values_over_listed_junctions(spark):
    a = assignments(spark, j0={0: 10, 1: 10}, j1={0: 150}, j2={0: 3, 1: 1})
    one = enhanced.risk(a).where("junction = 1").first()["risk"]
    rest = sum(r["risk"] for r in enhanced.risk(a).collect())
    assert enhanced.overall_risk(a, [0, 1, 2, 7, 8]).first()["risk"] == pytest.approx(rest / 5)
    assert enhanced.overall_risk(a, [1, 9]).first()["risk"] == pytest.approx(one / 2)
    assert enhanced.overall_efficiency(a, [0, 1, 2, 3]).first()["efficiency"] == pytest.approx((1 + 0.8112781) / 4)
    assert enhanced.overall_risk(a, []).first()["risk"] == 0.0
    whole = enhanced.overview(a, junctions=[0, 1, 2, 3]).first()
    assert whole["overall_risk"] == pytest.approx(rest / 4) and whole["bottlenecks"] == enhanced.bottlenecks(a).count()
