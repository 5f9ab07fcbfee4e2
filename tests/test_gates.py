"""Rules per column: what is accepted, what is not, and that all diagnostics come first."""

import pytest

from measurelake.contracts import ContractError
from measurelake.operators import compare
from measurelake.operators.compare import Rule
from measurelake.plans.gate_queries import RULES

FIELDS = "probe string, k int, cohorts string, effect double, se double, p double, tau2 double"
ROW = {"probe": "cg1", "k": 3, "cohorts": "A;B;C", "effect": 0.390750, "se": 0.25, "p": 0.553558795779051, "tau2": 0.855097}


def gated(spark, changes, base=None):
    old = ROW | (base or {})
    frame = lambda row: spark.createDataFrame([tuple(row.values())], FIELDS)
    return frame(old), frame(old | changes)


def test_round_off_is_accepted(spark):
    found = compare.require_gated(*gated(spark, {"p": ROW["p"] * (1 + 4e-9), "effect": ROW["effect"] + 9e-6, "tau2": ROW["tau2"] + 9e-5}), ["probe"], RULES)
    rows = {r.column_name: r for r in found.collect()}
    assert set(rows) == set(RULES) and rows["p"].largest_absolute == pytest.approx(ROW["p"] * 4e-9, rel=1e-3) and rows["p"].violations == 0


@pytest.mark.parametrize(
    "changes, base, reason",
    [
        ({"effect": 0.4}, {}, "numerical tolerance exceeded"),
        ({"k": 4}, {}, "exact label or count mismatch"),
        ({"cohorts": "A;B;D"}, {}, "exact label or count mismatch"),
        ({"se": None}, {}, "missing-value mask changed"),
        ({"p": 0.0500000001}, {"p": 0.0499999999}, "decision at 0.05 changed"),
        ({"effect": 1e-10}, {"effect": -1e-10}, "direction changed"),
        ({"tau2": 1e-10}, {"tau2": 0.0}, "zero boundary changed"),
        ({"p": 1e-19}, {"p": 1e-20}, "numerical tolerance exceeded"),
        ({"effect": 0.01 + 2e-5}, {"effect": 0.01}, "numerical tolerance exceeded"),
        ({"tau2": 0.092325 + 2e-4}, {"tau2": 0.092325}, "numerical tolerance exceeded"),
        ({"p": 1.0 + 1e-12}, {"p": 1.0}, "probability out of bounds"),
        ({"se": float("inf")}, {}, "nonfinite numerical result"),
        ({"se": -1e-9}, {"se": 1e-9}, "not positive"),
        ({"probe": "cg2"}, {}, "unexpected key"),
    ],
)
def test_changes_are_rejected(spark, changes, base, reason):
    with pytest.raises(ContractError, match=reason):
        compare.require_gated(*gated(spark, changes, base), ["probe"], RULES)


def test_all_diagnostics_before_failure(spark):
    violations, diagnostics = compare.gated(*gated(spark, {"effect": 2.0, "p": 0.03}), ["probe"], RULES)
    assert {(r.column_name, r.reason) for r in violations.collect()} == {("effect", "numerical tolerance exceeded"), ("p", "numerical tolerance exceeded"), ("p", "decision at 0.05 changed")}
    assert {r.column_name: r.violations for r in diagnostics.collect()} == {"effect": 1, "se": 0, "p": 2, "tau2": 0}


def test_keys_and_columns(spark):
    a, b = gated(spark, {})
    assert [r.reason for r in compare.gated(a.union(a), b, ["probe"], RULES)[0].collect()] == ["duplicated key"]
    assert [r.reason for r in compare.gated(a, b.limit(0), ["probe"], RULES)[0].collect()] == ["missing key"]
    assert compare.gated(a.limit(0), b.limit(0), ["probe"], RULES)[0].count() == 0
    with pytest.raises(ContractError):
        compare.gated(a, b.drop("k"), ["probe"], RULES)
    with pytest.raises(ContractError):
        compare.gated(a, b, ["probe"], {"none": Rule()})
