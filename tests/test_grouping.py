import random

import pytest

from triagewright import schemas as S
from triagewright.functions import text as T
from triagewright.operators import grouping as G

TIMEOUT = "org.openqa.selenium.TimeoutException: waiting for By.xpath: //a[@resource-id='{}']"


def failures(spark, rows):
    """rows: (step, error, stack, image)"""
    full = [("r", i, f"TC-{i}", "s", step, error, image, "", "f", stack, "", "") for i, (step, error, stack, image) in enumerate(rows)]
    return spark.createDataFrame(full, S.FAILURES)


def groups(spark, rows, threshold=0.80):
    got = G.group_failures(T.components(failures(spark, rows)), threshold).collect()
    return [g for _, g in sorted((r.failure_idx, r.group_idx) for r in got)]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("And tap", "java.lang.AssertionError: a"), ("And tap", "java.lang.AssertionError: a")], [0, 0]),
        ([("Then tap", "java.lang.AssertionError: a"), ("And tap", "java.lang.AssertionError: a")], [0, 0]),
        ([("tap", "java.lang.AssertionError: 12"), ("tap", "java.lang.AssertionError: 345")], [0, 0]),
        ([("tap", TIMEOUT.format("card_1")), ("tap", TIMEOUT.format("card_2"))], [0, 1]),
        ([("tap", "a.TimeoutException: x"), ("tap", "a.OtherException: x")], [0, 1]),
        ([('open "Targets"', "a.TimeoutException"), ('open "Rewards"', "a.TimeoutException")], [0, 1]),
        ([("tap", None), ("tap", "a.TimeoutException")], [0, 1]),
        ([("tap", "a.TimeoutException: x"), ("swipe", "a.TimeoutException: x"), ("tap", "a.TimeoutException: x")], [0, 1, 0]),
        ([("tap", TIMEOUT.format("card")), ("tap", "a.TimeoutException: x")], [0, 1]),
        ([("tap", "refused"), ("tap", "refused")], [0, 1]),
    ],
)
def test_cases(spark, rows, want):
    assert groups(spark, [(s, e, None, "") for s, e in rows]) == want


def test_representative_has_the_image(spark):
    f = failures(spark, [("tap", "a.TimeoutException", None, ""), ("tap", "a.TimeoutException", None, "data:image/png;base64,x")])
    heads = G.representatives(G.group_failures(T.components(f)), f).collect()
    assert [(r.group_idx, r.representative_idx, r.members) for r in heads] == [(0, 1, 2)]


def plain(parts, threshold):
    heads, out = [], []
    for i, p in enumerate(parts):
        best, group = -1.0, None
        for h in heads:
            if (s := G.score(parts[h], p)) > best:
                best, group = s, h
        if group is not None and best >= threshold:
            out.append(group)
        else:
            heads.append(i)
            out.append(i)
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.60, 0.70, 0.78, 0.80, 0.85, 0.86, 0.88, 0.95, 1.0, 1.2])
def test_plans_equal_the_leader_rule(spark, threshold):
    rng = random.Random(int(threshold * 100))
    rows = [(rng.choice(["tap", "swipe", ""]), rng.choice(["a.TimeoutException: x", "a.TimeoutException: y", TIMEOUT.format("c1"), TIMEOUT.format("c2"), "plain", None]), rng.choice([None, "at app.A(x:1)", "at app.B(x:1)"]), "") for _ in range(160)]
    parts = T.components(failures(spark, rows)).orderBy("failure_idx").select(*G.PARTS).collect()
    assert groups(spark, rows, threshold) == plain([tuple(p) for p in parts], threshold)


def test_pair_scores_equal_the_rule(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["tap", "swipe"]), rng.choice(["a.TimeoutException: x", TIMEOUT.format("c1"), TIMEOUT.format("c2"), "plain", None]), rng.choice([None, "at app.A(x:1)"]), "") for _ in range(40)]
    f = T.components(failures(spark, rows))
    parts = [tuple(p) for p in f.orderBy("failure_idx").select(*G.PARTS).collect()]
    got = {(r.a_idx, r.b_idx): r.score for r in G.pair_scores(f).collect()}
    want = {(i, j): G.score(parts[i], parts[j]) for i in range(40) for j in range(i + 1, 40) if parts[i][0] == parts[j][0]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_metrics(spark):
    f = failures(spark, [("tap", "a.TimeoutException: 1", None, ""), ("tap", "a.TimeoutException: 2", None, ""), ("swipe", None, None, "")])
    calls = spark.createDataFrame([("r", 0, 1, True, 50), ("r", 0, 2, True, 70), ("r", 2, 1, False, 5)], "report_id string, group_idx long, attempt int, vision boolean, total_ms long")
    m = G.report_metrics(f, G.group_failures(T.components(f)), calls).first()
    assert (m.failures, m.groups, m.exact_groups, m.calls, m.calls_avoided, m.retries, m.text_calls, m.vision_calls, m.total_ms) == (3, 2, 2, 2, 1, 1, 1, 1, 125)
    assert G.report_metrics(f.limit(0), G.group_failures(T.components(f.limit(0)))).collect() == []


def test_pair_totals_cover_all_reports(spark):
    from triagewright import registry

    d = "/root/testdata/sf0.001"
    f = registry.parts(spark, d)
    want = {}
    for r in G.pair_scores(f).collect():
        w = want.setdefault(r.report_id, [0, 0.0, 0, 0])
        want[r.report_id] = [w[0] + 1, w[1] + r.score, w[2] + (r.score >= 0.8), w[3] + bool(r.error_body_match)]
    got = {r.report_id: r for r in registry.QUERIES["pair_totals"](spark, d).collect()}
    assert len(got) > 2 and got.keys() == want.keys()
    assert all([g.pairs, g.alike, g.bodies] == [want[k][i] for i in (0, 2, 3)] and abs(g.total - want[k][1]) < 1e-3 for k, g in got.items())


def test_tiles_change_no_pair(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["tap", "swipe", ""]), rng.choice(["a.TimeoutException: x", TIMEOUT.format("c1"), TIMEOUT.format("c2"), "plain", "other", None]), rng.choice([None, "at app.A(x:1)"]), "") for _ in range(60)]
    f = T.components(failures(spark, rows)).cache()
    whole, tiled = (sorted(map(str, G.scored_kinds(f, tile).collect())) for tile in (1024, 2))
    assert whole == tiled and len(whole) > 20


def test_many_leaders_of_one_key(spark):
    """Distinct parts that all share step and exception: the first leads, whichever follow; with locators that differ, each leads alone."""
    n = 300
    assert groups(spark, [("tap", f"a.TimeoutException: {c}{i}x", None, "") for i in range(n) for c in "a"], 0.60) == [0] * n
    got = groups(spark, [("tap", TIMEOUT.format("k" + "xy"[i % 2] * (i // 2)), None, "") for i in range(40)], 0.60)
    assert got == [min(j for j in range(40) if j == i or (j // 2 == 0 and i // 2 == 0)) for i in range(40)]
