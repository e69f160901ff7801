"""PAT rows, over all scales. In the SQL a run and a scale together are one run, ``run#core``, so that a scale is one more series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candlemill.catalog import sql as S
from candlemill.catalog.bars_and_features import r6
from candlemill.catalog.registry import add
from candlemill.catalog.trading import PREFIX_SQL, _digits
from candlemill.config import NEUTRAL_PATTERNS, PATTERN_NAMES, PatternConfig, settings_hash
from candlemill.functions.columns import canonical_hash
from candlemill.operators import controls as N, features as T, trades as X
from candlemill.patterns import detect as D, matchers as M, smoothing as SM
from candlemill.sources import views as V
from candlemill.sources.series import stored


def _geometry(c: str) -> str:
    """Logarithms are identified to ten decimals: their last bits differ between engines."""
    return f"CAST(CAST(round({c} * 10000000000) AS BIGINT) AS VARCHAR)"


ONE = PatternConfig(core_lengths=(35,))
ALL = PatternConfig()


def windows(s, d) -> DataFrame:
    return stored(s, ("windows", d), lambda: SM.pivot_windows(V.walk_bars(s, d), ALL, every=True))


def matched(s, d) -> DataFrame:
    return stored(s, ("matched", d), lambda: M.match_patterns(windows(s, d), ALL))


def scale():
    return F.col("core_length").cast("long").alias("core_length")


def _scales() -> str:
    rows = []
    for c in ALL.core_lengths:
        near, far = ALL.double_spacing(c)
        rows.append(f"({c}, {ALL.observation_length(c)}, {ALL.context(c)}, {ALL.context(c) + c - 1}, {ALL.max_age(c)}, {near}, {far})")
    widths = [f"({c}, {b!r}::DOUBLE)" for c in ALL.core_lengths for b in ALL.bandwidths(c)]
    return f"sc(core, ob, lead, last, age, near, far) AS (VALUES {', '.join(rows)}), bw(core, b) AS (VALUES {', '.join(widths)})"


LONGEST = max(ALL.observation_length(c) for c in ALL.core_lengths)
RUN, CORE = "split_part({0}.run_id, '#', 1) AS run_id", "CAST(split_part({0}.run_id, '#', 2) AS BIGINT)"


def _key(t: str) -> str:
    """Run and scale of a row of ``t``."""
    return f"{RUN.format(t)}, {CORE.format(t)} AS core_length"


def _with_scale(t: str) -> str:
    return f"JOIN sc ON sc.core = {CORE.format(t)}"


def found(s, d) -> D.Detection:
    """The full detector once per session; every PAT row below reads its tables."""
    members = stored(s, ("members", d), lambda: D.detect(V.walk_bars(s, d), ALL).candidates)
    return D.Detection(members, members.filter("is_primary"), D.cluster_summary(members))


add(
    "PAT1_rolling_windows",
    lambda s, d: SM.window_index(V.walk_bars(s, d)).groupBy("run_id", "core_length", "observation_length").agg(
        F.count(F.lit(1)).alias("windows"), F.min("window_start").alias("first_start"), F.max("window_end").alias("last_end"))
    .withColumns({c: F.col(c).cast("long") for c in ("core_length", "observation_length")}),
    f"""WITH {S.WALK}, n AS (SELECT run_id, count(*) AS n FROM bars GROUP BY 1)
    SELECT run_id, core_length, observation_length, n - observation_length + 1 AS windows, 0 AS first_start, n - 1 AS last_end
    FROM n, (VALUES (35, 43), (55, 67), (80, 96)) v(core_length, observation_length) WHERE n >= observation_length""",
)

SMOOTH = f"""{S.WALK}, {_scales()},
rl0 AS (SELECT run_id, bar_index, ln(close) - ln(first_value(close) OVER (PARTITION BY run_id ORDER BY bar_index)) AS x FROM bars),
rl AS (SELECT run_id || '#' || core AS run_id, core, ob, bar_index, x FROM rl0, sc),
k0 AS (SELECT core, b, i, j, (j - i)::DOUBLE AS d, exp(-0.5::DOUBLE * power((j - i) / b, 2)) AS k FROM bw JOIN sc USING (core), range({LONGEST}) p(i), range({LONGEST}) q(j) WHERE i < ob AND j < ob),
k1 AS (SELECT core, b, i, sum(k) AS m0, sum(k * d) AS m1, sum(k * d * d) AS m2 FROM k0 GROUP BY 1, 2, 3),
k2 AS (SELECT core, b, i, j, k * (m2 - m1 * d) / (m0 * m2 - m1 * m1) AS w FROM k0 JOIN k1 USING (core, b, i)),
wt AS MATERIALIZED (SELECT core, b, i, j, w / sum(w) OVER (PARTITION BY core, b, i) AS w FROM k2),
wn AS MATERIALIZED (SELECT e.run_id, e.core, e.bar_index AS we, r.bar_index - e.bar_index + e.ob - 1 AS j, r.x FROM rl e
  JOIN rl r ON r.run_id = e.run_id AND r.bar_index BETWEEN e.bar_index - e.ob + 1 AND e.bar_index WHERE e.bar_index >= e.ob - 1),
cv AS (SELECT run_id, we, i, b, sum(x * w) AS v FROM wn JOIN wt ON wt.core = wn.core AND wt.j = wn.j WHERE abs(w) > 1e-17 GROUP BY ALL),
sm AS MATERIALIZED (SELECT run_id, we, i, median(v) AS v FROM cv GROUP BY ALL),
rs AS MATERIALIZED (SELECT sm.run_id, sm.we, sm.i, sm.v, wn.x, wn.x - sm.v AS res FROM sm JOIN wn ON wn.run_id = sm.run_id AND wn.we = sm.we AND wn.j = sm.i),
rmd AS (SELECT run_id, we, median(res) AS md FROM rs GROUP BY 1, 2),
nz AS MATERIALIZED (SELECT rs.run_id, rs.we, 1.4826::DOUBLE * median(abs(res - md)) AS noise FROM rs JOIN rmd ON rmd.run_id = rs.run_id AND rmd.we = rs.we GROUP BY 1, 2)"""

add(
    "PAT2_local_linear_smoother",
    lambda s, d: SM.smoothed_windows(V.walk_bars(s, d), ALL).select("run_id", scale(), "window_end", r6("smooth_middle", digits=8), r6("smooth_end", digits=8)),
    f"""WITH {SMOOTH} SELECT {_key("sm")}, we AS window_end, round(max(CASE WHEN i = ob // 2 THEN v END), 8) AS smooth_middle,
    round(max(CASE WHEN i = ob - 1 THEN v END), 8) AS smooth_end FROM sm {_with_scale("sm")} GROUP BY 1, 2, 3""",
)
add(
    "PAT3_residual_noise",
    lambda s, d: SM.smoothed_windows(V.walk_bars(s, d), ALL).select("run_id", scale(), "window_end", r6("noise", digits=8)),
    f"WITH {SMOOTH} SELECT {_key('nz')}, we AS window_end, round(noise, 8) AS noise FROM nz",
)

PIVOTS = f"""{SMOOTH},
ex0 AS (SELECT *, v - lag(v) OVER w AS sl, lead(v) OVER w - v AS sr,
  min(v) OVER (PARTITION BY run_id, we ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lmin, max(v) OVER (PARTITION BY run_id, we ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lmax,
  min(v) OVER (PARTITION BY run_id, we ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS rmin, max(v) OVER (PARTITION BY run_id, we ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS rmax,
  lag(x) OVER w AS xp, lead(x) OVER w AS xn FROM rs WINDOW w AS (PARTITION BY run_id, we ORDER BY i)),
ex1 AS (SELECT *, CASE WHEN sl >= 0 AND sr < 0 THEN 1 WHEN sl <= 0 AND sr > 0 THEN -1 END AS kd FROM ex0 WHERE sl IS NOT NULL AND sr IS NOT NULL),
ex2 AS (SELECT ex1.*, noise, CASE WHEN kd = 1 THEN greatest(0, v - greatest(lmin, rmin)) ELSE greatest(0, least(lmax, rmax) - v) END AS pr,
  CASE WHEN kd * xp >= kd * x AND kd * xp >= kd * xn THEN i - 1 WHEN kd * x >= kd * xn THEN i ELSE i + 1 END AS ri
  FROM ex1 JOIN nz ON nz.run_id = ex1.run_id AND nz.we = ex1.we WHERE kd IS NOT NULL),
ex AS MATERIALIZED (SELECT run_id, we, i, v, kd, pr, ri, row_number() OVER (PARTITION BY run_id, we ORDER BY i) AS k FROM ex2 WHERE pr >= greatest(1e-10, 0.75 * noise)),
th AS (SELECT run_id, we, k, [{{'i': i, 'v': v, 'kd': kd, 'pr': pr, 'ri': ri}}] AS kept FROM ex WHERE k = 1
  UNION ALL SELECT e.run_id, e.we, e.k, CASE
     WHEN e.kd = t.kept[-1].kd THEN CASE WHEN e.kd * e.v > e.kd * t.kept[-1].v THEN list_append(t.kept[1:len(t.kept) - 1], {{'i': e.i, 'v': e.v, 'kd': e.kd, 'pr': e.pr, 'ri': e.ri}}) ELSE t.kept END
     WHEN e.i - t.kept[-1].i < 2 THEN CASE WHEN e.pr > t.kept[-1].pr THEN list_append(t.kept[1:len(t.kept) - 1], {{'i': e.i, 'v': e.v, 'kd': e.kd, 'pr': e.pr, 'ri': e.ri}}) ELSE t.kept END
     ELSE list_append(t.kept, {{'i': e.i, 'v': e.v, 'kd': e.kd, 'pr': e.pr, 'ri': e.ri}}) END
  FROM th t JOIN ex e ON e.run_id = t.run_id AND e.we = t.we AND e.k = t.k + 1),
tl AS (SELECT run_id, we, arg_max(kept, k) AS kept FROM th GROUP BY 1, 2),
tu AS (SELECT run_id, we, unnest(kept) AS p FROM tl),
tv AS (SELECT run_id, we, p.i AS i, p.v AS v, p.kd AS kd, p.pr AS pr, p.ri AS ri, lag(p.kd) OVER (PARTITION BY run_id, we ORDER BY p.i) AS pk FROM tu),
tw AS (SELECT *, sum(CASE WHEN pk IS NULL OR pk <> kd THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, we ORDER BY i) AS g FROM tv),
tx AS (SELECT *, row_number() OVER (PARTITION BY run_id, we, g ORDER BY kd * v DESC, i) AS z FROM tw),
pv0 AS MATERIALIZED (SELECT run_id, we, i, v, kd, pr, ri, row_number() OVER (PARTITION BY run_id, we ORDER BY i) AS n FROM tx WHERE z = 1),
hold AS (SELECT DISTINCT a.run_id, a.we FROM pv0 a JOIN pv0 b ON b.run_id = a.run_id AND b.we = a.we AND b.n = a.n + 2 {_with_scale("a")} WHERE a.i >= lead AND b.i <= last AND last - b.i <= age),
pv AS MATERIALIZED (SELECT pv0.* FROM pv0 JOIN hold ON hold.run_id = pv0.run_id AND hold.we = pv0.we)"""


def _pivot_text(part):
    return F.concat_ws(",", F.transform("pivots", part))


add(
    "PAT4_pivot_prominence",
    lambda s, d: windows(s, d).select("run_id", scale(), "window_end", F.explode("pivots").alias("p")).select(
        "run_id", "core_length", "window_end", F.col("p.idx").cast("long").alias("idx"), r6("prominence", F.col("p.prominence"), 8)),
    f"WITH RECURSIVE {PIVOTS} SELECT {_key('pv0')}, we AS window_end, i AS idx, round(pr, 8) AS prominence FROM pv0",
)
add(
    "PAT5_pivot_sequences",
    lambda s, d: windows(s, d).filter(F.size("pivots") > 0).select(
        "run_id", scale(), "window_end", F.size("pivots").cast("long").alias("n"),
        _pivot_text(lambda p: p["idx"].cast("string")).alias("idx"), _pivot_text(lambda p: p["raw_idx"].cast("string")).alias("raw_idx"),
        _pivot_text(lambda p: F.when(p["is_max"], "1").otherwise("-1")).alias("kinds")),
    f"""WITH RECURSIVE {PIVOTS} SELECT {_key("pv0")}, we AS window_end, count(*) AS n, string_agg(i, ',' ORDER BY i) AS idx, string_agg(ri, ',' ORDER BY i) AS raw_idx,
    string_agg(kd, ',' ORDER BY i) AS kinds FROM pv0 GROUP BY 1, 2, 3""",
)

_lead5 = ", ".join(f"lead(i, {k}) OVER w AS x{k + 1}, lead(v, {k}) OVER w AS y{k + 1}" for k in range(1, 5))
BLOCKS = f"""{PIVOTS},
bl0 AS (SELECT run_id, we, i AS x1, v AS y1, kd, {_lead5} FROM pv WINDOW w AS (PARTITION BY run_id, we ORDER BY i)),
bl AS (SELECT bl0.*, ob, lead, last, age, near, far FROM bl0 {_with_scale("bl0")}),
b5 AS (SELECT * FROM bl WHERE x1 >= lead AND x5 <= last AND last - x5 <= age AND x5 - x1 + 1 >= 5),
b3 AS (SELECT * FROM bl WHERE x1 >= lead AND x3 <= last AND last - x3 <= age AND x3 - x1 + 1 >= 5)"""


def _blocks(s, d):
    five = M.pivot_blocks(windows(s, d), 5, ALL).select("run_id", scale(), "window_end", F.lit(5).alias("size"), F.col("p1.idx").alias("first"), F.col("p5.idx").alias("last"))
    three = M.pivot_blocks(windows(s, d), 3, ALL).select("run_id", scale(), "window_end", F.lit(3).alias("size"), F.col("p1.idx").alias("first"), F.col("p3.idx").alias("last"))
    return five.unionByName(three).withColumns({c: F.col(c).cast("long") for c in ("size", "first", "last")})


add("PAT6_pivot_blocks", _blocks,
    f"""WITH RECURSIVE {BLOCKS} SELECT {_key("b5")}, we AS window_end, 5 AS size, x1 AS first, x5 AS last FROM b5
    UNION ALL SELECT {_key("b3")}, we, 3, x1, x3 FROM b3""")


def wide5(s, d) -> DataFrame:
    return M.channel_columns(M.shoulder_columns(M._points(M.pivot_blocks(windows(s, d), 5, ALL), 5)))


def _line_sql(p, ks):
    xs, ys = [f"x{k}" for k in ks], [f"y{k}" for k in ks]
    n = len(ks)
    mx, my = "(" + "+".join(xs) + f")/{n}.0::DOUBLE", "(" + "+".join(ys) + f")/{n}.0::DOUBLE"
    num = "+".join(f"({a}-{mx})*({b}-{my})" for a, b in zip(xs, ys))
    den = "+".join(f"({a}-{mx})*({a}-{mx})" for a in xs)
    s1 = f"({num})/({den}) AS {p}s, {mx} AS {p}mx, {my} AS {p}my"
    s2 = f"{p}my - {p}s*{p}mx AS {p}i"
    sse = "+".join(f"power({b}-{p}s*{a}-{p}i,2)" for a, b in zip(xs, ys))
    sst = "+".join(f"power({b}-{p}my,2)" for b in ys)
    rng = f"greatest(greatest({','.join(ys)})-least({','.join(ys)}),1e-12)"
    r2 = "1.0" if n == 2 else f"greatest(0,least(1,CASE WHEN {sst}<=1e-12 THEN CASE WHEN {sse}<=1e-12 THEN 1 ELSE 0 END ELSE 1-({sse})/({sst}) END))"
    s3 = f"{r2} AS {p}r, sqrt(({sse})/{n})/{rng} AS {p}e, {rng} AS {p}g"
    return s1, s2, s3


_o, _e = _line_sql("o", (1, 3, 5)), _line_sql("e", (2, 4))
GEO = f"""{BLOCKS},
g1 AS (SELECT *, {_o[0]}, {_e[0]} FROM b5), g2 AS (SELECT *, {_o[1]}, {_e[1]} FROM g1), g3 AS (SELECT *, {_o[2]}, {_e[2]},
  (y4-y2)/greatest(x4-x2,1) AS nk FROM g2),
g4 AS (SELECT *, CASE WHEN kd=1 THEN os ELSE es END AS us, CASE WHEN kd=1 THEN oi ELSE ei END AS ui, CASE WHEN kd=1 THEN es ELSE os END AS ls, CASE WHEN kd=1 THEN ei ELSE oi END AS li,
  least(1.0, 0.5*oe+0.5*ee) AS rp, greatest(y1,y2,y3,y4,y5)-least(y1,y2,y3,y4,y5) AS fh, CASE WHEN kd=1 THEN omy-emy ELSE emy-omy END AS rh, y2-nk*x2 AS n0,
  exp(-abs(ln((x3-x1)/(x5-x3)::DOUBLE))) AS tsc, greatest(x3-x1,x5-x3)/least(x3-x1,x5-x3)::DOUBLE AS asy FROM g3),
g5 AS (SELECT *, (us*x2+ui)-(ls*x2+li) AS w0, (us*x4+ui)-(ls*x4+li) AS w1, (li-ui)/nullif(us-ls,0) AS ax, kd*(y1-(nk*x1+n0)) AS c1, kd*(y3-(nk*x3+n0)) AS hd, kd*(y5-(nk*x5+n0)) AS c5 FROM g4), """
GEO += """
m AS (
 SELECT run_id, we, ob, lead, last, kd, x1, x5 AS xe, 5 AS sz, CASE WHEN kd=1 THEN 'head_and_shoulders' ELSE 'inverse_head_and_shoulders' END AS pattern_name, hd AS pattern_height,
   0.30*(1-least(1,abs(c1-c5)/hd/0.75))+0.18*(1-least(1,abs(y4-y2)/hd/1.25))+0.24*least(1,(hd-0.5*(c1+c5))/hd)+0.18*tsc+0.10*least(1,least(c1,c5)/hd) AS fit,
   nk AS usl, n0 AS uin, nk AS lsl, n0 AS lin, NULL::DOUBLE AS apex, CASE WHEN kd=1 THEN 'down' ELSE 'up' END AS rule FROM g5
 WHERE kd*y3>kd*y1 AND kd*y3>kd*y5 AND hd>1e-12 AND least(c1,c5)>=0.05*hd AND hd>greatest(c1,c5) AND (hd-0.5*(c1+c5))/hd>=0.15 AND abs(c1-c5)/hd<=0.75 AND abs(y4-y2)/hd<=1.25 AND asy<=3
 UNION ALL SELECT run_id, we, ob, lead, last, kd, x1, x5, 5, 'broadening_formation', fh, 0.30*"or"+0.30*er+0.30*least(1,(w1/w0-1)/0.3)+0.10*(1-rp), us, ui, ls, li, NULL, 'expanding' FROM g5
   WHERE us>0 AND ls<0 AND w0>1e-12 AND w1>w0 AND w1/w0-1>=0.10
 UNION ALL SELECT run_id, we, ob, lead, last, kd, x1, x5, 5, 'rectangle', rh, 0.5*(1-least(1,(CASE WHEN kd=1 THEN og ELSE eg END)/rh/0.35))+0.5*(1-least(1,(CASE WHEN kd=1 THEN eg ELSE og END)/rh/0.35)),
   0, CASE WHEN kd=1 THEN omy ELSE emy END, 0, CASE WHEN kd=1 THEN emy ELSE omy END, NULL, 'horizontal' FROM g5 WHERE rh>1e-12 AND og/rh<=0.35 AND eg/rh<=0.35
 UNION ALL SELECT run_id, we, ob, lead, last, kd, x1, x5, 5, 'symmetrical_triangle', fh, 0.35*(0.5*"or"+0.5*er)+0.35*least(1,(1-w1/w0)/0.36)+0.20*greatest(0,1-(ax-x4)/greatest(1,x5-x1)/2.5)+0.10*(1-rp),
   us, ui, ls, li, ax, 'converging' FROM g5 WHERE us<0 AND ls>0 AND w0>1e-12 AND w1>0 AND w1<w0 AND 1-w1/w0>=0.12 AND ax>x4 AND ax-x4<=2.5*greatest(1,x5-x1)
 UNION ALL SELECT run_id, we, ob, lead, last, kd, x1, x3, 3, CASE WHEN kd=1 THEN 'double_top' ELSE 'double_bottom' END, least(kd*y1,kd*y3)-kd*y2,
   0.80*(1-least(1,abs(y1-y3)/(least(kd*y1,kd*y3)-kd*y2)/0.75))+0.20*exp(-0.5*power(((x3-x1)-0.5*(near+far))/greatest(1,0.5*(far-near)),2)), 0, y2, 0, y2, NULL, CASE WHEN kd=1 THEN 'down' ELSE 'up' END FROM b3
   WHERE least(kd*y1,kd*y3)-kd*y2>1e-12 AND x3-x1>=near AND x3-x1<=far AND abs(y1-y3)/(least(kd*y1,kd*y3)-kd*y2)<=0.75),
mc AS MATERIALIZED (SELECT m.*, greatest(1e-10, 2*noise) AS thr FROM m JOIN nz ON nz.run_id=m.run_id AND nz.we=m.we WHERE pattern_height>=greatest(1e-10, 2*noise))"""

add(
    "PAT7_boundary_line_fit",
    lambda s, d: wide5(s, d).select("run_id", scale(), "window_end", F.col("p1.idx").cast("long").alias("first"),
                                    r6("slope", F.col("odd_slope"), 8), r6("icpt", F.col("odd_icpt"), 7), r6("r2", F.col("odd_r2"), 5), r6("nrmse", F.col("odd_nrmse"))),
    f'''WITH RECURSIVE {GEO} SELECT {_key("g5")}, we AS window_end, x1 AS first, round(os, 8) AS slope, round(oi, 7) AS icpt, round("or", 5) AS r2, round(oe, 6) AS nrmse FROM g5''',
)
add(
    "PAT8_time_symmetry",
    lambda s, d: wide5(s, d).select("run_id", scale(), "window_end", F.col("p1.idx").cast("long").alias("first"), r6("score", F.col("time_score")), r6("ratio", F.col("asym"))),
    f"WITH RECURSIVE {GEO} SELECT {_key('g5')}, we AS window_end, x1 AS first, round(tsc, 6) AS score, round(asy, 6) AS ratio FROM g5",
)


def _family(name: str, names: tuple[str, ...]) -> None:
    listed = ", ".join(f"'{n}'" for n in names)
    add(name,
        lambda s, d: matched(s, d).filter(F.col("pattern_name").isin(*names)).select(
            "run_id", scale(), "window_end", "pattern_name", F.col("block")[0]["idx"].cast("long").alias("first"), r6("pattern_height"), r6("fit", F.col("geometry_fit_score"))),
        f"""WITH RECURSIVE {GEO} SELECT {_key("mc")}, we AS window_end, pattern_name, x1 AS first, round(pattern_height, 6) AS pattern_height,
        round(greatest(0, least(1, fit)), 6) AS fit FROM mc WHERE pattern_name IN ({listed})""")


_family("PAT9_head_and_shoulders", ("head_and_shoulders", "inverse_head_and_shoulders"))
_family("PAT10_broadening", ("broadening_formation",))
_family("PAT11_rectangle", ("rectangle",))
_family("PAT12_triangle", ("symmetrical_triangle",))
_family("PAT13_double_top_bottom", ("double_top", "double_bottom"))
_family("PAT14_all_families", PATTERN_NAMES)
add(
    "PAT15_height_and_age_filter",
    lambda s, d: matched(s, d).groupBy("run_id", scale(), "pattern_name").agg(
        F.count(F.lit(1)).alias("n"), r6("min_over_threshold", F.min(F.col("pattern_height") / F.col("pattern_height_threshold")), 5),
        F.max(M.by_core(ALL, ALL.context) + F.col("core_length") - 1 - F.element_at("block", -1)["idx"]).cast("long").alias("max_age")),
    f"""WITH RECURSIVE {GEO} SELECT {_key("mc")}, pattern_name, count(*) AS n, round(min(pattern_height / thr), 5) AS min_over_threshold, max(last - xe) AS max_age FROM mc GROUP BY 1, 2, 3""",
)
BREAKS = """
    bt AS MATERIALIZED (SELECT mc.*, wn.j AS t, wn.x AS val, usl*wn.j+uin AS up, lsl*wn.j+lin AS lo FROM mc JOIN wn ON wn.run_id=mc.run_id AND wn.we=mc.we AND wn.j>mc.xe),
    bs AS (SELECT *, CASE WHEN rule='down' THEN CASE WHEN val<lo THEN -1 ELSE 0 END WHEN rule='up' THEN CASE WHEN val>up THEN 1 ELSE 0 END
       WHEN rule='converging' AND (t+1e-9>=apex OR up<=lo) THEN 2 WHEN rule='expanding' AND up<=lo THEN 0 WHEN val>up THEN 1 WHEN val<lo THEN -1 ELSE 0 END AS st FROM bt),
    bf AS (SELECT *, row_number() OVER (PARTITION BY run_id, we, pattern_name, x1 ORDER BY t) AS k FROM bs WHERE st<>0),
    hit AS MATERIALIZED (SELECT * FROM bf WHERE k=1 AND st<>2),
    dd AS (SELECT hit.run_id, hit.we, pattern_name, x1, a.x-b.x AS df FROM hit JOIN wn a ON a.run_id=hit.run_id AND a.we=hit.we AND a.j BETWEEN greatest(0,t-10)+1 AND t JOIN wn b ON b.run_id=a.run_id AND b.we=a.we AND b.j=a.j-1),
    dm AS (SELECT *, median(df) OVER (PARTITION BY run_id, we, pattern_name, x1) AS md FROM dd),
    sg AS (SELECT run_id, we, pattern_name, x1, 1.4826*median(abs(df-md)) AS sigma FROM dm GROUP BY 1,2,3,4)"""

add(
    "PAT16_breakouts",
    lambda s, d: M.find_breakouts(matched(s, d), ALL).select(
        "run_id", scale(), "window_end", "pattern_name", F.col("block")[0]["idx"].cast("long").alias("first"), "breakout_confirmed", "breakout_direction",
        "breakout_index", r6("breakout_strength_height"), r6("breakout_strength_volatility", digits=5)),
    f"""WITH RECURSIVE {GEO}, {BREAKS}
    SELECT {_key("mc")}, mc.we AS window_end, mc.pattern_name, mc.x1 AS first, hit.t IS NOT NULL AS breakout_confirmed, CASE hit.st WHEN 1 THEN 'bullish' WHEN -1 THEN 'bearish' END AS breakout_direction,
      mc.we - mc.ob + 1 + hit.t AS breakout_index, round(abs(val - CASE WHEN hit.st=1 THEN up ELSE lo END)/greatest(mc.pattern_height,1e-12),6) AS breakout_strength_height,
      round(CASE WHEN sigma>1e-12 THEN abs(val - CASE WHEN hit.st=1 THEN up ELSE lo END)/sigma END,5) AS breakout_strength_volatility
    FROM mc LEFT JOIN hit ON hit.run_id=mc.run_id AND hit.we=mc.we AND hit.pattern_name=mc.pattern_name AND hit.x1=mc.x1
    LEFT JOIN sg ON sg.run_id=mc.run_id AND sg.we=mc.we AND sg.pattern_name=mc.pattern_name AND sg.x1=mc.x1""",
)

# --- candidates, events and clusters of the whole detector ------------------------------------------


def _txt(c: str):
    return F.concat_ws(",", F.transform(c, lambda v: v.cast("string"))).alias(c)


CONTEXT = ["pre_pattern_log_return", "pre_pattern_trend_slope", "pre_pattern_log_volatility", "pre_pattern_robust_log_volatility",
           "pattern_log_volatility", "pattern_robust_log_volatility", "pattern_to_pre_volume_ratio", "pattern_to_pre_log_volume_ratio", "pattern_mean_log_high_low_range"]
PUBLIC = ["start_index", "end_index", "available_at_index", "entry_index", "core_start_index", "core_end_index", "pattern_span_bars",
          "pattern_age_at_availability_bars", "pattern_age_at_core_end_bars", "observation_window_length", "core_window_length"]
SHORT = ALL.core_lengths[0]

# A candidate of the SQL: its run and scale, first bar ``o`` of its window, first and last bar ``a`` and ``z``, and its id.
CAND = f"""{GEO}, cd AS MATERIALIZED (SELECT mc.*, split_part(run_id, '#', 1) AS run, CAST(split_part(run_id, '#', 2) AS BIGINT) AS core, we - ob + 1 AS o, we - ob + 1 + x1 AS a, we - ob + 1 + xe AS z,
  'C-' || substr(sha256('{{"run_id":"' || split_part(run_id, '#', 1) || '","core_length":' || split_part(run_id, '#', 2) || ',"window_end":' || we || ',"pattern_name":"' || pattern_name
    || '","start_index":' || (we - ob + 1 + x1) || '}}'), 1, 20) AS cid FROM mc)"""
WICKS = f"""{CAND}, wk AS (SELECT cd.run, cd.core, cd.we, pattern_name, a, cid, pv.i, b.bar_index, row_number() OVER (PARTITION BY cid, pv.i ORDER BY CASE WHEN pv.kd = 1 THEN -b.high ELSE b.low END, b.bar_index) AS k
      FROM cd JOIN pv ON pv.run_id = cd.run_id AND pv.we = cd.we AND pv.i BETWEEN cd.x1 AND cd.xe
      JOIN bars b ON b.run_id = cd.run AND b.bar_index BETWEEN greatest(a, cd.o + pv.i - 1) AND least(z, cd.o + pv.i + 1)),
wo AS (SELECT run, core, we, pattern_name, a, cid, string_agg(bar_index, ',' ORDER BY i) AS wicks FROM wk WHERE k = 1 GROUP BY ALL)"""
AROUND = f"""{CAND}, cj AS (SELECT cd.run, cd.core, cd.we, pattern_name, a, cid, b.bar_index, b.bar_index < a AS pre, rl0.x, b.volume, ln(b.high / b.low) AS rg
      FROM cd JOIN bars b ON b.run_id = cd.run AND b.bar_index BETWEEN a - 10 AND z JOIN rl0 ON rl0.run_id = b.run_id AND rl0.bar_index = b.bar_index),
dj AS (SELECT *, x - lag(x) OVER (PARTITION BY cid, pre ORDER BY bar_index) AS df FROM cj),
mj AS (SELECT *, median(df) OVER (PARTITION BY cid, pre) AS md FROM dj),
g AS (SELECT run, core, we, pattern_name, a, cid, pre, arg_max(x, bar_index) - arg_min(x, bar_index) AS ret, regr_slope(x, bar_index) AS sl, stddev_pop(df) AS sd, 1.4826 * median(abs(df - md)) AS rb,
      avg(volume) AS v, avg(rg) AS rg FROM mj GROUP BY 1, 2, 3, 4, 5, 6, 7)"""
CONTEXT_SQL = """round(p.ret, 6) AS pre_pattern_log_return, round(p.sl, 6) AS pre_pattern_trend_slope, round(p.sd, 6) AS pre_pattern_log_volatility,
      round(p.rb, 6) AS pre_pattern_robust_log_volatility, round(i.sd, 6) AS pattern_log_volatility, round(i.rb, 6) AS pattern_robust_log_volatility, round(i.v / p.v, 6) AS pattern_to_pre_volume_ratio,
      round(ln(i.v / p.v), 6) AS pattern_to_pre_log_volume_ratio, round(i.rg, 6) AS pattern_mean_log_high_low_range
    FROM g i JOIN g p ON p.cid = i.cid AND p.pre AND NOT i.pre"""
ALIKE = "CASE WHEN kd = 1 THEN 'high' ELSE 'low' END AS phase_start"

add("PAT17_wick_refined_pivots",
    lambda s, d: found(s, d).candidates.select("run_id", "candidate_id", _txt("pivot_indices"), _txt("pivot_wick_refined"), _txt("pivot_close_refined")),
    f"""WITH RECURSIVE {WICKS}, po AS (SELECT cid, string_agg(o + pv.i, ',' ORDER BY pv.i) AS idx, string_agg(o + pv.ri, ',' ORDER BY pv.i) AS raw FROM cd
      JOIN pv ON pv.run_id = cd.run_id AND pv.we = cd.we AND pv.i BETWEEN cd.x1 AND cd.xe GROUP BY 1)
    SELECT run AS run_id, cid AS candidate_id, idx AS pivot_indices, wicks AS pivot_wick_refined, raw AS pivot_close_refined FROM wo JOIN po USING (cid)""")
add("PAT18_context_features", lambda s, d: found(s, d).candidates.select("run_id", "candidate_id", *[r6(c) for c in CONTEXT]),
    f"WITH RECURSIVE {AROUND} SELECT i.run AS run_id, i.cid AS candidate_id, {CONTEXT_SQL}")
add("PAT19_global_coordinates",
    lambda s, d: found(s, d).candidates.select("run_id", "candidate_id", r6("upper_intercept_global", digits=5), r6("lower_intercept_global", digits=5), r6("apex_global", digits=4)),
    f"""WITH RECURSIVE {CAND} SELECT run AS run_id, cid AS candidate_id, round(uin - usl * o, 5) AS upper_intercept_global, round(lin - lsl * o, 5) AS lower_intercept_global,
    round(apex + o, 4) AS apex_global FROM cd""")
add("PAT20_public_candidates",
    lambda s, d: found(s, d).candidates.select("run_id", "candidate_id", "pattern_name", "expected_direction", "phase_start", *[F.col(c).cast("long").alias(c) for c in PUBLIC],
                                               r6("geometry_fit_score"), "config_hash"),
    f"""WITH RECURSIVE {CAND} SELECT run AS run_id, cid AS candidate_id, pattern_name, CASE rule WHEN 'down' THEN 'bearish' WHEN 'up' THEN 'bullish' ELSE 'neutral' END AS expected_direction, {ALIKE},
    a AS start_index, z AS end_index, we AS available_at_index, we + 1 AS entry_index, o + lead AS core_start_index, o + last AS core_end_index, xe - x1 + 1 AS pattern_span_bars,
    ob - 1 - xe AS pattern_age_at_availability_bars, last - xe AS pattern_age_at_core_end_bars, ob AS observation_window_length, core AS core_window_length,
    round(greatest(0, least(1, fit)), 6) AS geometry_fit_score, '{settings_hash(ALL, D.DETECTOR_RULES)}' AS config_hash FROM cd""")


def geometry_prefix(s, d, bars=V.walk_bars):
    rel = T.relative_log_price(bars(s, d))
    # A price of zero has an infinite logarithm or none that is a number: it is identified by its name.
    digits = F.when(F.abs("rel_log") < float("inf"), F.round(F.col("rel_log") * 1e10).cast("long").cast("string")).otherwise(F.col("rel_log").cast("string"))
    text = F.concat_ws("|", F.col("bar_index").cast("string"), digits)
    return N.running_fingerprint(rel, text, "geometry_prefix")


add("PAT21_causal_prefix_fingerprints", geometry_prefix,
    f"""WITH {S.WALK}, rl AS (SELECT run_id, bar_index, ln(close) - ln(first_value(close) OVER (PARTITION BY run_id ORDER BY bar_index)) AS x FROM bars)
    SELECT run_id, bar_index, sha256(bar_index || ':' || CAST(sum(CAST(('0x' || substr(md5(bar_index || '|' || {_geometry('x')}), 1, 15))::UBIGINT AS HUGEINT))
      OVER (PARTITION BY run_id ORDER BY bar_index) AS VARCHAR)) AS geometry_prefix FROM rl""")


def series_fingerprints(s, d):
    """Whole-series fingerprint: the last prefix of the run."""
    p = N.price_prefixes(V.lineitem_bars(s, d)).join(geometry_prefix(s, d, V.lineitem_bars), ["run_id", "bar_index"])
    last = F.struct("prefix", "geometry_prefix")
    return p.groupBy("run_id").agg(F.max_by(last, "bar_index").alias("l"), F.count(F.lit(1)).alias("bars")).select(
        "run_id", "bars", F.col("l.prefix").alias("market_fingerprint"), F.col("l.geometry_prefix").alias("geometry_fingerprint"))


_MD = f"""CAST(('0x' || substr(md5(bar_index || '|' || {_digits('open')} || '|' || {_digits('high')} || '|' || {_digits('low')} || '|' || {_digits('close')} || '|' || volume), 1, 15))::UBIGINT AS HUGEINT)"""
_GD = f"""CAST(('0x' || substr(md5(bar_index || '|' || {_geometry('x')}), 1, 15))::UBIGINT AS HUGEINT)"""
add("PAT22_series_fingerprints", series_fingerprints,
    f"""WITH {S.LI}, rl AS (SELECT *, ln(close) - ln(first_value(close) OVER (PARTITION BY run_id ORDER BY bar_index)) AS x FROM bars)
    SELECT run_id, count(*) AS bars, sha256(max(bar_index) || ':' || CAST(sum({_MD}) AS VARCHAR)) AS market_fingerprint,
      sha256(max(bar_index) || ':' || CAST(sum({_GD}) AS VARCHAR)) AS geometry_fingerprint FROM rl GROUP BY 1""")
_ALIGNED = "len(list_filter(list_zip({x}, {y}, {kx}, {ky}), lambda p: abs(p[1] - p[2]) <= {t} AND p[3] = p[4])) = len({x})"


def _dropped(name: str, k: str) -> str:
    return f"list_concat({name}[1:{k} - 1], {name}[{k} + 1:])"


# Shapes of neutral families have five pivots: they share four in order when some four of each stand in line.
_FOUR = _ALIGNED.format(x=_dropped("a.pl", "(k // 5 + 1)"), y=_dropped("b.pl", "(k % 5 + 1)"), kx=_dropped("a.kl", "(k // 5 + 1)"), ky=_dropped("b.kl", "(k % 5 + 1)"), t=ALL.cluster_pivot_tolerance)
_NEUTRAL = ", ".join(f"'{n}'" for n in NEUTRAL_PATTERNS)
_SHARED = "greatest(0, least({a}.z, {b}.z) - greatest({a}.a, {b}.a) + 1) / (least({a}.z - {a}.a, {b}.z - {b}.a) + 1)::DOUBLE"
_PIVOTS = f"""CASE WHEN b.pattern_name IN ({_NEUTRAL}) THEN CASE WHEN {_ALIGNED.format(x="a.pl", y="b.pl", kx="a.kl", ky="b.kl", t=ALL.cluster_pivot_tolerance)} THEN 1.0::DOUBLE
    WHEN len(list_filter(range(25), lambda k: {_FOUR})) > 0 THEN 0.8::DOUBLE ELSE 0 END
  WHEN a.kl = b.kl THEN len(list_filter(list_zip(a.pl, b.pl), lambda p: abs(p[1] - p[2]) <= {ALL.cluster_pivot_tolerance})) / len(a.pl)::DOUBLE ELSE 0 END"""

# Members: candidates in causal order, their links to earlier ones, first members by a walk, and the best of these for each.
EVENTS = f"""{CAND}, {PREFIX_SQL},
pk AS (SELECT cid, list(o + pv.i ORDER BY pv.i) AS pl, list(CASE WHEN pv.kd = 1 THEN 'max' ELSE 'min' END ORDER BY pv.i) AS kl FROM cd
   JOIN pv ON pv.run_id = cd.run_id AND pv.we = cd.we AND pv.i BETWEEN cd.x1 AND cd.xe GROUP BY 1),
id AS MATERIALIZED (SELECT cd.run, cd.core, cd.we, cd.pattern_name, cd.a, cd.z, cd.cid, cd.fit, cd.x1, cd.run_id, pl, kl, 'EV-' || substr(sha256('{{"available_at_index":' || cd.we || ',"config_hash":"{settings_hash(ALL, D.DETECTOR_RULES)}","end_index":' || z
   || ',"pattern_name":"' || pattern_name || '","pivot_indices":[' || array_to_string(pl, ',') || '],"pivot_kinds":["' || array_to_string(kl, '","') || '"],"prefix":"' || prefix || '","run_id":"' || run
   || '","start_index":' || a || '}}'), 1, 18) AS own FROM cd JOIN pk ON pk.cid = cd.cid JOIN pf ON pf.run_id = cd.run AND pf.bar_index = cd.we),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run, pattern_name ORDER BY we, -greatest(0, least(1, fit)), a, z, core, cid) AS step FROM id),
l0 AS (SELECT b.run, b.pattern_name, b.step, a.step AS other, {_SHARED.format(a="a", b="b")} AS ov, {_PIVOTS} AS pm,
   greatest(0, 1 - abs((a.a + a.z) - (b.a + b.z)) / 2.0::DOUBLE / greatest({ALL.cluster_center_tolerance} * greatest(1, least(a.z - a.a, b.z - b.a)), 1)) AS ce
   FROM rk a JOIN rk b ON a.run = b.run AND a.pattern_name = b.pattern_name AND a.step < b.step AND a.z >= b.a AND a.z >= b.we - {ALL.warmup_bars}),
lk AS MATERIALIZED (SELECT *, {D.SIMILARITY_WEIGHTS["overlap"]}::DOUBLE * ov + {D.SIMILARITY_WEIGHTS["pivots"]}::DOUBLE * pm + {D.SIMILARITY_WEIGHTS["centre"]}::DOUBLE * ce AS sim FROM l0
   WHERE ov >= {ALL.cluster_min_overlap} AND pm >= CASE WHEN pattern_name IN ({_NEUTRAL}) THEN {ALL.cluster_min_pivot_match_neutral} ELSE {ALL.cluster_min_pivot_match} END),
bk AS MATERIALIZED (SELECT rk.run, rk.pattern_name, rk.step, list(other) FILTER (other IS NOT NULL) AS back FROM rk LEFT JOIN lk ON lk.run = rk.run AND lk.pattern_name = rk.pattern_name AND lk.step = rk.step GROUP BY 1, 2, 3),
fm AS (SELECT run, pattern_name, step, [step] AS firsts FROM bk WHERE step = 1
   UNION ALL SELECT k.run, k.pattern_name, k.step, CASE WHEN list_has_any(w.firsts, coalesce(k.back, [])) THEN w.firsts ELSE list_append(w.firsts, k.step) END
   FROM fm w JOIN bk k ON k.run = w.run AND k.pattern_name = w.pattern_name AND k.step = w.step + 1),
fs AS MATERIALIZED (SELECT run, pattern_name, unnest(arg_max(firsts, step)) AS step FROM fm GROUP BY 1, 2),
ba AS (SELECT lk.*, row_number() OVER (PARTITION BY lk.run, lk.pattern_name, lk.step ORDER BY sim DESC, other) AS n FROM lk
   JOIN fs ON fs.run = lk.run AND fs.pattern_name = lk.pattern_name AND fs.step = lk.other),
mb AS MATERIALIZED (SELECT b.*, coalesce(a.own, b.own) AS ev, a.own IS NULL AS prime, ba.sim, coalesce(ba.ov, 1) AS ov, coalesce(ba.pm, 1) AS pm,
   CASE WHEN a.own IS NULL THEN 'primary' WHEN b.pattern_name IN ({_NEUTRAL}) AND a.kl <> b.kl THEN 'phase_shift_extension' ELSE 'same_structure_view' END AS relation
   FROM rk b LEFT JOIN ba ON ba.run = b.run AND ba.pattern_name = b.pattern_name AND ba.step = b.step AND ba.n = 1
   LEFT JOIN rk a ON a.run = ba.run AND a.pattern_name = ba.pattern_name AND a.step = ba.other)"""
EV = "WITH RECURSIVE " + EVENTS
# Members with their breakouts, and the earliest confirmed member of each event.
BROKEN = f"""{EVENTS}, {BREAKS},
br AS MATERIALIZED (SELECT mb.*, st FROM mb LEFT JOIN hit ON hit.run_id = mb.run_id AND hit.we = mb.we AND hit.pattern_name = mb.pattern_name AND hit.x1 = mb.x1),
cf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run, ev ORDER BY we, a, z, -greatest(0, least(1, fit)), cid) AS n FROM br WHERE st IS NOT NULL)"""
_SIDE = "CASE st WHEN 1 THEN 'bullish' WHEN -1 THEN 'bearish' END"

add("PAT23_event_identity", lambda s, d: found(s, d).candidates.select("run_id", "candidate_id", "own_event_id", "event_id"),
    f"""{EV} SELECT run AS run_id, cid AS candidate_id, own AS own_event_id, ev AS event_id FROM mb""")


def primary_pairs(s, d):
    """Each member next to the first member of its event."""
    c = found(s, d).candidates
    p = c.filter("is_primary").select("run_id", "event_id", F.col("start_index").alias("p_start"), F.col("end_index").alias("p_end"),
                                      F.col("pivot_indices").alias("p_pivots"), F.col("pivot_kinds").alias("p_kinds"))
    return c.join(p, ["run_id", "event_id"])


add("PAT24_interval_overlap", lambda s, d: primary_pairs(s, d).select("run_id", "candidate_id", r6("overlap", D.interval_overlap(
    F.col("start_index"), F.col("end_index"), F.col("p_start"), F.col("p_end")))),
    f"""{EV} SELECT run AS run_id, cid AS candidate_id, round(ov, 6) AS overlap FROM mb""")


def _parts(s, d):
    """Every member beside the first member of its event, with the parts of their similarity."""
    c = found(s, d).candidates
    a = c.filter("is_primary").select("run_id", "event_id", F.struct(*D.SHAPE).alias("a"))
    return D.pair_parts(c.select("run_id", "event_id", "candidate_id", "pattern_name", "relation", F.struct(*D.SHAPE).alias("b")).join(a, ["run_id", "event_id"]), ALL)


add("PAT25_pivot_agreement", lambda s, d: _parts(s, d).select("run_id", "candidate_id", "relation", r6("pivot_match", F.col("pivots"))),
    f"""{EV} SELECT run AS run_id, cid AS candidate_id, relation, round(pm, 6) AS pivot_match FROM mb""")
add("PAT26_structural_similarity", lambda s, d: found(s, d).candidates.filter("NOT is_primary").select("run_id", "candidate_id", "event_id", r6("anchor_similarity")),
    f"""{EV} SELECT run AS run_id, cid AS candidate_id, ev AS event_id, round(sim, 6) AS anchor_similarity FROM mb WHERE NOT prime""")
add("PAT27_causal_clusters", lambda s, d: found(s, d).candidates.select("run_id", "candidate_id", "event_id", "is_primary"),
    f"""{EV} SELECT run AS run_id, cid AS candidate_id, ev AS event_id, prime AS is_primary FROM mb""")
add("PAT28_member_relation", lambda s, d: found(s, d).candidates.groupBy("run_id", "pattern_name", "relation").agg(F.count(F.lit(1)).alias("members")),
    f"""{EV} SELECT run AS run_id, pattern_name, relation, count(*) AS members FROM mb GROUP BY ALL""")
add("PAT29_competition", lambda s, d: found(s, d).candidates.select("run_id", "candidate_id", "competing_pattern", _txt("competing_event_ids"), _txt("competing_patterns")),
    f"""{EV}, cp AS (SELECT m.cid, o.ev AS oe, o.pattern_name AS op FROM mb m JOIN mb o ON o.run = m.run AND o.prime AND o.pattern_name <> m.pattern_name AND o.ev <> m.ev AND o.we <= m.we
      AND {_SHARED.format(a="m", b="o")} >= {ALL.competition_overlap}),
    cs AS (SELECT cid, array_to_string(list_sort(list(DISTINCT oe)), ',') AS es, array_to_string(list_sort(list(DISTINCT op)), ',') AS ps FROM cp GROUP BY 1)
    SELECT run AS run_id, mb.cid AS candidate_id, es IS NOT NULL AS competing_pattern, coalesce(es, '') AS competing_event_ids, coalesce(ps, '') AS competing_patterns FROM mb LEFT JOIN cs ON cs.cid = mb.cid""")
add("PAT30_cluster_summary", lambda s, d: found(s, d).clusters.select("run_id", "event_id", "pattern_name", "members", _txt("supporting_core_windows"), "first_available_at_index", "last_available_at_index"),
    f"""{EV} SELECT run AS run_id, ev AS event_id, pattern_name, count(*) AS members, array_to_string(list_sort(list(DISTINCT core)), ',') AS supporting_core_windows,
    min(we) AS first_available_at_index, max(we) AS last_available_at_index FROM mb GROUP BY 1, 2, 3""")
add("PAT31_confirmed_view", lambda s, d: D.confirmed_events(found(s, d).candidates).select("run_id", "event_id", "pattern_name", "available_at_index", "entry_index", "breakout_direction"),
    f"""WITH RECURSIVE {BROKEN} SELECT run AS run_id, ev AS event_id, pattern_name, we AS available_at_index, we + 1 AS entry_index, {_SIDE} AS breakout_direction FROM cf WHERE n = 1""")
add("PAT32_signal_priority", lambda s, d: D.confirmed_events(found(s, d).candidates).withColumn("priority", X.signal_priority()).select(
    "run_id", "event_id", F.col("priority.family").cast("long").alias("family_rank"), F.col("priority.a").alias("available"), r6("negative_fit", F.col("priority.f"))),
    f"""WITH RECURSIVE {BROKEN} SELECT run AS run_id, ev AS event_id, list_position([{", ".join(f"'{n}'" for n in PATTERN_NAMES)}], pattern_name) - 1 AS family_rank, we::DOUBLE AS available,
    round(-greatest(0, least(1, fit)), 6) AS negative_fit FROM cf WHERE n = 1""")
add("PAT33_detector_outputs", lambda s, d: found(s, d).candidates.groupBy("run_id", "pattern_name").agg(
    F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("is_primary"), 1)).alias("events"), F.count(F.when(F.col("breakout_confirmed"), 1)).alias("confirmed_candidates")),
    f"""WITH RECURSIVE {BROKEN} SELECT run AS run_id, pattern_name, count(*) AS candidates, count(*) FILTER (prime) AS events, count(*) FILTER (st IS NOT NULL) AS confirmed_candidates
    FROM br GROUP BY 1, 2""")
add(
    "PAT34_warmup_lengths",
    lambda s, d: SM.window_index(V.walk_bars(s, d)).groupBy("run_id", F.col("core_length").cast("long").alias("core_length")).agg(F.min("window_end").alias("first_available")),
    f"""WITH {S.WALK} SELECT run_id, core_length, ob - 1 AS first_available FROM (SELECT run_id, count(*) AS n FROM bars GROUP BY 1), (VALUES (35, 43), (55, 67), (80, 96)) v(core_length, ob) WHERE n >= ob""",
)
add("PAT35_event_listing", lambda s, d: D.event_listing(found(s, d).events),
    f"""WITH RECURSIVE {BROKEN} SELECT run AS run_id, we AS available_at_index, ev AS event_id, format('{{}} [{{}}-{{}}] known at bar {{}}, fit {{:.3f}}, breakout {{}}', pattern_name, a, z, we,
    greatest(0, least(1, fit)), coalesce({_SIDE}, 'none')) AS line FROM br WHERE prime""")

# --- the same for one scale alone: what a detector of only that scale finds -------------------------------


def short(s, d) -> DataFrame:
    """Candidates of a detector that knows the shortest scale only."""
    alone = lambda: SM.pivot_windows(V.walk_bars(s, d), ONE)
    return stored(s, ("short", d), lambda: D.public_candidates(M.find_breakouts(M.match_patterns(alone(), ONE), ONE), ONE))


add("PAT20_short_scale_candidates",
    lambda s, d: short(s, d).select("run_id", "pattern_name", "start_index", "end_index", "available_at_index", "entry_index", "phase_start",
        *[F.col(c).cast("long").alias(c) for c in ("pattern_span_bars", "pattern_age_at_availability_bars", "pattern_age_at_core_end_bars")]),
    f"""WITH RECURSIVE {CAND} SELECT run AS run_id, pattern_name, a AS start_index, z AS end_index, we AS available_at_index, we + 1 AS entry_index, {ALIKE},
    xe - x1 + 1 AS pattern_span_bars, ob - 1 - xe AS pattern_age_at_availability_bars, last - xe AS pattern_age_at_core_end_bars FROM cd WHERE core = {SHORT}""")
add("PAT19_short_scale_coordinates",
    lambda s, d: short(s, d).select("run_id", "window_end", "pattern_name", "start_index", r6("upper_intercept_global", digits=5), r6("lower_intercept_global", digits=5), r6("apex_global", digits=4)),
    f"""WITH RECURSIVE {CAND} SELECT run AS run_id, we AS window_end, pattern_name, a AS start_index, round(uin - usl * o, 5) AS upper_intercept_global,
    round(lin - lsl * o, 5) AS lower_intercept_global, round(apex + o, 4) AS apex_global FROM cd WHERE core = {SHORT}""")
add("PAT17_short_scale_wicks",
    lambda s, d: D.refine_pivots(short(s, d), V.walk_bars(s, d), ONE).select("run_id", "window_end", "pattern_name", "start_index", _txt("pivot_wick_refined")),
    f"WITH RECURSIVE {WICKS} SELECT run AS run_id, we AS window_end, pattern_name, a AS start_index, wicks AS pivot_wick_refined FROM wo WHERE core = {SHORT}")
add("PAT18_short_scale_context",
    lambda s, d: D.context_features(short(s, d), V.walk_bars(s, d), ONE).select("run_id", "window_end", "pattern_name", "start_index", *[r6(c) for c in CONTEXT]),
    f"WITH RECURSIVE {AROUND} SELECT i.run AS run_id, i.we AS window_end, i.pattern_name, i.a AS start_index, {CONTEXT_SQL} WHERE i.core = {SHORT}")
