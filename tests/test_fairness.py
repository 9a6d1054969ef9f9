"""Worked answers for rates, gaps and pairs, and a brute-force check of the pair search."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evenhand.operators.fairness import fairness, group_rates, pair_gaps, wide, worst_pairs
from evenhand.spec import FairSpec

SPEC = FairSpec(("g",), "y", ("client",), ("id",))
PRED = FairSpec(("g",), "y", ("client",), ("id",), "p")


def rows_of(counts):
    """(group, n, positives) to rows of one client."""
    out, key = [], 0
    for g, n, pos in counts:
        for i in range(n):
            out.append(("c", key, g, i < pos))
            key += 1
    return out


@pytest.fixture
def three(table):
    return table("client string, id long, g string, y boolean", *rows_of([("a", 4, 3), ("b", 4, 1), ("c", 2, 1)]))


def test_dp_levels(three):
    assert fairness(three, SPEC, "DP", "attribute").first()["gap"] == 0.5
    worst = fairness(three, SPEC, "DP", "value").first()
    assert (worst["pair"], worst["g_i"], worst["g_j"], worst["gap"]) == ("a_b", "a", "b", 0.5)
    pairs = {r["pair"]: r["gap"] for r in fairness(three, SPEC, "DP", "attribute-value").collect()}
    assert len(pairs) == 9 and pairs["b_a"] == -0.5 and pairs["a_a"] == pairs["b_b"] == 0
    assert all(pairs[f"{i}_{j}"] == -pairs[f"{j}_{i}"] for i, j in itertools.product("abc", repeat=2))


def test_wide_forms(three):
    value = wide(fairness(three, SPEC, "DP", "value"), SPEC, "DP", "value").first()
    assert (value["g_DP"], value["g_val"]) == (0.5, "a_b")
    attribute = wide(fairness(three, SPEC, "DP", "attribute"), SPEC, "DP", "attribute").first()
    assert attribute["g_DP"] == attribute["g_val"] == 0.5
    each = wide(fairness(three, SPEC, "DP", "attribute-value"), SPEC, "DP", "attribute-value").first()
    assert each["a_c"] == 0.25 and each["c_a"] == -0.25


def eo_rows(groups):
    """(group, positives, true positives, negatives, false positives)"""
    out, key = [], 0
    for g, pos, tp, neg, fp in groups:
        for y, n, hits in ((True, pos, tp), (False, neg, fp)):
            for i in range(n):
                out.append(("c", key, g, y, i < hits))
                key += 1
    return out


EO_SCHEMA = "client string, id long, g string, y boolean, p boolean"


def test_eo_tie_goes_to_true_positives(table):
    df = table(EO_SCHEMA, *eo_rows([("a", 4, 4, 4, 2), ("b", 4, 2, 4, 0)]))
    assert fairness(df, PRED, "EO", "value").first()["pair"] == "a_b"
    df = table(EO_SCHEMA, *eo_rows([("a", 4, 4, 4, 2), ("b", 4, 3, 4, 4)]))
    pairs = {r["pair"]: r["gap"] for r in fairness(df, PRED, "EO", "attribute-value").collect()}
    assert pairs["a_b"] == -0.5 and pairs["b_a"] == 0.5
    assert fairness(df, PRED, "EO", "value").first()["pair"] == "b_a"


def test_equal_rates_give_the_first_pair(table):
    df = table("client string, id long, g string, y boolean", *rows_of([("a", 2, 1), ("b", 4, 2)]))
    worst = fairness(df, SPEC, "DP", "value").first()
    assert (worst["pair"], worst["gap"]) == ("a_a", 0.0)


def test_numbers_are_ordered_by_size_and_keep_their_text(table):
    df = table("client string, id long, g double, y boolean",
               *[("c", i, g, y) for i, (g, y) in enumerate([(10.0, True), (2.0, True), (3.0, False)])])
    assert fairness(df, SPEC, "DP", "value").first()["pair"] == "2.0_3.0"


def test_intersection_and_null_groups(table):
    spec = FairSpec(("a", "b"), "y", ("client",), ("id",))
    df = table("client string, id long, a double, b string, y boolean",
               ("c", 1, 1.0, "x", True), ("c", 2, 2.0, "x", False), ("c", 3, None, "x", True))
    worst = fairness(df, spec, "DP", "value", intersect=True).first()
    assert worst["pair"] == "(1.0, 'x')_(2.0, 'x')" and worst["attribute"] == "a*b"
    assert {r["g"] for r in group_rates(df, spec).where("attribute = 'a'").collect()} == {"1.0", "2.0"}


def test_checks(three):
    with pytest.raises(ValueError, match="metric"):
        fairness(three, SPEC, "XX").collect()
    with pytest.raises(ValueError, match="level"):
        fairness(three, SPEC, "DP", "x")
    with pytest.raises(ValueError, match="not present"):
        fairness(three, FairSpec(("g",), "nope"))


rate = st.sampled_from([None, 0.0, 0.25, 0.5, 0.75, 1.0])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(rate, rate), min_size=1, max_size=6), min_size=25, max_size=25))
def test_pair_search_equals_all_pairs(spark, clients):
    """The linear search finds what sorting all pairs finds, for every pattern of ties and missing rates."""
    rows = [(str(c), "g", str(i), [(float(i), None)], t, f)
            for c, groups in enumerate(clients) for i, (t, f) in enumerate(groups)]
    rates = spark.createDataFrame(rows, "client string, attribute string, g string, "
                                  "ord array<struct<number:double,text:string>>, tpr double, fpr double")
    got = {r["client"]: (r["gap"], r["pair"]) for r in worst_pairs(rates, SPEC, "EO").collect()}
    expected = {}
    for c, groups in enumerate(clients):
        for (i, (ti, fi)), (j, (tj, fj)) in itertools.product(enumerate(groups), repeat=2):
            if fi is None or fj is None:
                continue
            df = fi - fj
            dt = None if ti is None or tj is None else ti - tj
            gap = dt if dt is not None and abs(dt) >= abs(df) else df
            if str(c) not in expected or gap > expected[str(c)][0]:
                expected[str(c)] = (gap, f"{i}_{j}")
    assert got == expected
    listed = {}
    for r in pair_gaps(rates, SPEC, "EO").where("gap is not null").collect():
        listed.setdefault(r["client"], []).append(r["gap"])
    assert {c: max(g) for c, g in listed.items()} == {c: g for c, (g, _) in expected.items()}
