"""Detector properties: causality, scale invariance, order invariance, brute force on small series."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.config import NEUTRAL_PATTERNS, PatternConfig
from candlemill.patterns import detect as D, matchers as M, smoothing as SM
from candlemill.sources.views import walk_bars

CONFIG = PatternConfig()
KEY = ["run_id", "core_length", "window_end", "pattern_name", "start_index", "end_index"]


@pytest.fixture(scope="module")
def bars(spark):
    """Three random walks of 400 bars with drift changes, one of them tenfold in price."""
    rng = np.random.default_rng(11)
    rows = []
    for r in range(3):
        p = np.exp(np.cumsum(rng.normal(0, 0.01, 400))) * (1000.0 if r == 2 else 100.0)
        rows += [(f"r{r}", i, float(c), float(c * 1.002), float(c * 0.998), float(c), int(100 + i % 7)) for i, c in enumerate(p)]
    return spark.createDataFrame(rows, "run_id string, bar_index long, open double, high double, low double, close double, volume long")


@pytest.fixture(scope="module")
def found(bars):
    return D.detect(bars, CONFIG)


def keys(df):
    return sorted(tuple(r) for r in df.select(*KEY).collect())


def test_finds_patterns(found):
    assert found.candidates.count() > 50
    assert found.events.count() == found.clusters.count()


def test_prefix_gives_the_same_candidates(bars, found):
    part = D.raw_candidates(bars.filter("bar_index < 250"), CONFIG)
    assert keys(part) == keys(found.candidates.filter("window_end < 250"))


def test_future_bars_do_not_change_event_ids(bars, found):
    part = D.detect(bars.filter("bar_index < 250"), CONFIG, context=False)
    ids = lambda df: sorted((r.run_id, r.event_id) for r in df.select("run_id", "event_id").distinct().collect())
    assert ids(part.candidates) == ids(found.candidates.filter("available_at_index < 250"))


def test_price_scale_does_not_matter(bars, found):
    scaled = bars.withColumns({c: F.col(c) * 7.5 for c in ("open", "high", "low", "close")})
    assert keys(D.raw_candidates(scaled, CONFIG)) == keys(found.candidates)


def test_chunk_length_does_not_matter(bars):
    a = SM.pivot_windows(bars, CONFIG, chunk=4096).select("run_id", "core_length", "window_end", F.size("pivots").alias("n"))
    b = SM.pivot_windows(bars, CONFIG, chunk=128).select("run_id", "core_length", "window_end", F.size("pivots").alias("n"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def common_run(a, b, tolerance):
    """Longest common subsequence of (place, kind) lists by its full table."""
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, (x, kx) in enumerate(a):
        for j, (y, ky) in enumerate(b):
            met = kx == ky and abs(x - y) <= tolerance
            table[i + 1, j + 1] = table[i, j] + 1 if met else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def likeness(a, b, neutral):
    """Similarity of two candidates (rows) by its definition: 0 when bars or pivots agree too little."""
    bars_a, bars_b = (set(range(r.start_index, r.end_index + 1)) for r in (a, b))
    shared = len(bars_a & bars_b) / min(len(bars_a), len(bars_b))
    pa, pb = (list(zip(r.pivot_indices, r.pivot_kinds)) for r in (a, b))
    if neutral:
        pivots = common_run(pa, pb, CONFIG.cluster_pivot_tolerance) / min(len(pa), len(pb))
    else:
        same = [k for _, k in pa] == [k for _, k in pb]
        pivots = np.mean([abs(x - y) <= CONFIG.cluster_pivot_tolerance for (x, _), (y, _) in zip(pa, pb)]) if same else 0.0
    least = CONFIG.cluster_min_pivot_match_neutral if neutral else CONFIG.cluster_min_pivot_match
    span = max(1, min(len(bars_a), len(bars_b)) - 1)
    gap = abs(np.mean([a.start_index, a.end_index]) - np.mean([b.start_index, b.end_index]))
    centre = max(0.0, 1 - gap / max(1.0, CONFIG.cluster_center_tolerance * span))
    return np.dot([shared, pivots, centre], list(D.SIMILARITY_WEIGHTS.values())) if shared >= CONFIG.cluster_min_overlap and pivots >= least else 0.0


def test_clusters_equal_one_sequential_pass(found):
    pdf = found.candidates.withColumn("neg_fit", -F.col("geometry_fit_score")).toPandas()
    seen = 0
    for (run, name), g in pdf.groupby(["run_id", "pattern_name"]):
        firsts = []
        for r in g.sort_values(D.ORDER).itertuples():
            scores = [likeness(p, r, name in NEUTRAL_PATTERNS) for p in firsts]
            if not scores or max(scores) == 0:
                firsts.append(r)
                assert r.is_primary and r.event_id == r.own_event_id and r.relation == "primary"
            else:
                anchor = firsts[int(np.argmax(scores))]
                assert (r.is_primary, r.event_id) == (False, anchor.own_event_id) and r.anchor_similarity == pytest.approx(max(scores), abs=1e-12)
                moved = name in NEUTRAL_PATTERNS and list(anchor.pivot_kinds) != list(r.pivot_kinds)
                assert r.relation == ("phase_shift_extension" if moved else "same_structure_view")
                seen += 1
    assert seen > 20


def first_by_walk(n, links):
    back, firsts = {}, set()
    for step, other in links:
        back.setdefault(step, []).append(other)
    for step in range(n):
        if not firsts.intersection(back.get(step, ())):
            firsts.add(step)
    return firsts


@pytest.mark.parametrize("n, reach, each, chunk", [(300, 9, 3, 7), (300, 1, 1, 16), (2_000, 40, 2, 64), (100_000, 60, 4, 2048)])
def test_first_members_of_one_long_island(spark, n, reach, each, chunk):
    """Every candidate is linked with some just before it, so nothing cuts the island; chunks decide at once and agree with the walk."""
    rng = np.random.default_rng(n + reach)
    links = sorted({(i, int(i - d)) for i in range(1, n) for d in rng.integers(1, reach + 1, each) if d <= i})
    ranked = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("step"))
    table = spark.createDataFrame(__import__("pandas").DataFrame(links, columns=["step", "other"])).withColumn("g", F.lit("g"))
    got = {r.step for r in D.first_members(ranked, table, chunk=chunk).collect()}
    assert got == first_by_walk(n, links)


def test_row_order_does_not_change_clusters(spark, found):
    slim = found.candidates.drop("event_id", "is_primary", "anchor_similarity", "relation", "competing_pattern", "competing_event_ids", "competing_patterns")
    again = D.cluster_candidates(slim.orderBy(F.desc("candidate_id")), CONFIG)
    pick = lambda df: sorted((r.candidate_id, r.event_id) for r in df.select("candidate_id", "event_id").collect())
    assert pick(again) == pick(found.candidates)


def test_pivot_agreement(spark):
    rng = np.random.default_rng(8)
    rows = [([10, 20, 30], ["max", "min", "max"], [11, 22, 33], ["max", "min", "max"]), ([10, 20, 30], ["max", "min", "max"], [11, 22, 33], ["min", "max", "min"]),
            ([10, 20, 30], ["max", "min", "max"], [20, 30, 40], ["min", "max", "min"])]
    for _ in range(200):
        sides = []
        for _ in range(2):
            n = int(rng.integers(1, 7))
            sides += [sorted(rng.integers(0, 20, n).tolist()), rng.choice(["max", "min"], n).tolist()]
        rows.append(tuple(sides))
    df = spark.createDataFrame(rows, "a array<long>, ka array<string>, b array<long>, kb array<string>")
    args = [F.col(c) for c in ("a", "b", "ka", "kb")]
    got = df.select("*", D.placed_agreement(*args, 2).alias("placed"), D.ordered_agreement(*args, 2).alias("ordered")).collect()
    assert (got[0].placed, got[1].placed, got[2].ordered) == pytest.approx((2 / 3, 0.0, 2 / 3))
    for r in got:
        run = common_run(list(zip(r.a, r.ka)), list(zip(r.b, r.kb)), 2)
        assert r.ordered == pytest.approx(run / min(len(r.a), len(r.b)))


def test_wick_refinement_and_context_by_hand(bars, found):
    b = {(r.run_id, r.bar_index): r for r in bars.collect()}
    for r in found.candidates.limit(60).collect():
        for k, (i, kind) in enumerate(zip(r.pivot_indices, r.pivot_kinds)):
            near = range(max(r.start_index, i - 1), min(r.end_index, i + 1) + 1)
            best = max(near, key=lambda j: b[(r.run_id, j)].high) if kind == "max" else min(near, key=lambda j: b[(r.run_id, j)].low)
            assert r.pivot_wick_refined[k] == best
        pre = [np.log(b[(r.run_id, j)].close) for j in range(max(0, r.start_index - 10), r.start_index)]
        inside = [np.log(b[(r.run_id, j)].close) for j in range(r.start_index, r.end_index + 1)]
        assert r.pre_pattern_log_return == pytest.approx(pre[-1] - pre[0], abs=1e-9)
        assert r.pattern_log_volatility == pytest.approx(np.std(np.diff(inside)), abs=1e-9)
        d = np.diff(inside)
        assert r.pattern_robust_log_volatility == pytest.approx(1.4826 * np.median(np.abs(d - np.median(d))), abs=1e-9)
        assert r.pre_pattern_trend_slope == pytest.approx(np.polyfit(range(len(pre)), pre, 1)[0], abs=1e-9)


def test_competition_by_hand(found):
    rows = found.candidates.collect()
    heads = [r for r in rows if r.is_primary]
    for r in rows:
        def share(o):
            n = min(r.end_index, o.end_index) - max(r.start_index, o.start_index) + 1
            return n / (min(r.end_index - r.start_index, o.end_index - o.start_index) + 1) if n > 0 else 0.0
        want = sorted({o.event_id for o in heads if o.run_id == r.run_id and o.pattern_name != r.pattern_name and o.event_id != r.event_id
                       and o.available_at_index <= r.available_at_index and share(o) >= 0.40})
        assert list(r.competing_event_ids) == want and r.competing_pattern == bool(want)


def test_availability_contract(found):
    bad = found.candidates.filter(
        (F.col("entry_index") <= F.col("available_at_index")) | (F.col("end_index") >= F.col("available_at_index"))
        | (F.col("pattern_age_at_core_end_bars") > 12) | (F.col("breakout_index") > F.col("available_at_index")))
    assert bad.count() == 0


def test_confirmed_view_promotes_the_earliest_member(found):
    rows = D.confirmed_events(found.candidates).collect()
    first = {}
    for r in found.candidates.filter("breakout_confirmed").collect():
        k = (r.run_id, r.event_id)
        first[k] = min(first.get(k, r.available_at_index), r.available_at_index)
    assert {(r.run_id, r.event_id): r.available_at_index for r in rows} == first


def block(spark, points, core=35):
    pv = [dict(idx=i, raw_idx=i, value=v, raw_value=v, is_max=m, prominence=1.0) for i, v, m in points]
    return spark.createDataFrame([("r", core, 100, 1e-4, pv, [0.0] * 20)], SM.WINDOW_SCHEMA)


def test_rectangle_by_hand(spark):
    w = block(spark, [(8, 1.0, True), (14, 0.0, False), (20, 1.1, True), (26, 0.1, False), (34, 0.9, True)])
    r = M.match_patterns(w, PatternConfig(core_lengths=(35,))).filter("pattern_name = 'rectangle'").head()
    height = 1.0 - 0.05
    assert r.pattern_height == pytest.approx(height)
    assert r.geometry_fit_score == pytest.approx(0.5 * (1 - 0.2 / height / 0.35) + 0.5 * (1 - 0.1 / height / 0.35))


def test_head_and_shoulders_by_hand(spark):
    w = block(spark, [(8, 1.0, True), (14, 0.0, False), (20, 2.0, True), (26, 0.0, False), (34, 1.0, True)])
    r = M.match_patterns(w, PatternConfig(core_lengths=(35,))).filter("pattern_name = 'head_and_shoulders'").head()
    t = 12 / 14
    assert r.pattern_height == pytest.approx(2.0)
    assert r.geometry_fit_score == pytest.approx(0.30 + 0.18 + 0.24 * 0.5 + 0.18 * t + 0.10 * 0.5)


def test_smoother_keeps_straight_lines():
    m = SM.smoother(43, 1.575)
    line = 0.3 * np.arange(43) - 2
    assert np.allclose(m @ line, line, atol=1e-9)


def test_walk_view_runs_through_the_detector(spark, sf_dir):
    out = D.detect(walk_bars(spark, sf_dir), dataclasses.replace(CONFIG, require_double_confirmation=True), context=False)
    doubles = out.candidates.filter(F.col("pattern_name").isin("double_top", "double_bottom"))
    assert doubles.filter("NOT breakout_confirmed").count() == 0
