"""Reference SQL of the series, profile, feature, blend and submission queries."""

from __future__ import annotations

from shelfline.config import BlendConfig, SeriesConfig
from shelfline.forecast.blend import weight_candidates

REGIME = "BETWEEN DATE '1999-01-01' AND DATE '2000-06-30'"
MODELS = ("seasonal_728", "seasonal_735", "seasonal_742", "week_mean")
EVENTS = """((MONTH(ds) = 2 AND DAY(ds) BETWEEN 12 AND 14) OR (MONTH(ds) = 3 AND DAY(ds) BETWEEN 6 AND 8) OR (MONTH(ds) = 4 AND DAY(ds) BETWEEN 28 AND 30)
  OR (MONTH(ds) = 5 AND DAY(ds) = 1) OR (MONTH(ds) = 9 AND DAY(ds) BETWEEN 1 AND 2) OR (MONTH(ds) = 12 AND DAY(ds) BETWEEN 20 AND 31))"""
CALENDAR = f"""CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek, CAST(MONTH(ds) AS INTEGER) AS month, CAST(DAY(ds) AS INTEGER) AS day,
  CAST(DAYOFYEAR(ds) AS INTEGER) AS dayofyear, CAST(YEAR(ds) AS INTEGER) AS year, CAST(WEEKOFYEAR(ds) AS INTEGER) AS weekofyear,
  CAST(QUARTER(ds) AS INTEGER) AS quarter, CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN {EVENTS} THEN 1 ELSE 0 END AS is_gregorian_peak"""
HARMONICS = ", ".join(f"{fn.upper()}(2 * PI() * {k} * WEEKOFYEAR(ds) / 53.0) AS woy_{fn}_{k}" for k in (1, 2, 3, 4) for fn in ("sin", "cos"))
ONEHOT = ", ".join(f"CASE WHEN WEEKOFYEAR(ds) = {w} THEN 1 ELSE 0 END AS woy_oh_{w:02d}" for w in range(1, 54))


def profile_sql(source: str) -> str:
    clip = "GREATEST(LEAST({0}, {2}), {1})"
    ratio = lambda a: clip.format(f"COALESCE({a} / NULLIF(woy_profile_mean, 0), 1)", 0.5, 2.5)
    return f"""
WITH d AS MATERIALIZED (SELECT unique_id, ds, y, WEEKOFYEAR(ds) AS w, ISOYEAR(ds) AS iy FROM {source}),
tm AS (SELECT unique_id, AVG(y) AS tmean FROM d GROUP BY 1),
wk AS (SELECT unique_id, w, AVG(y) AS m, MEDIAN(y) AS md, STDDEV_SAMP(y) AS sd, COUNT(y) AS n FROM d GROUP BY 1, 2),
wy AS (SELECT unique_id, iy, w, AVG(y) AS m, ROUND(SUM(y), 6) AS total FROM d GROUP BY 1, 2, 3),
wx AS MATERIALIZED (SELECT *, m / NULLIF(LAG(m) OVER (PARTITION BY unique_id, w ORDER BY iy), 0) AS g, MAX(iy) OVER (PARTITION BY unique_id) AS my,
  RANK() OVER (PARTITION BY unique_id, iy ORDER BY total DESC) AS place FROM wy),
rc AS (SELECT unique_id, w, AVG(m) AS rmean, MEDIAN(m) AS rmed, MAX(m) AS rmax, COUNT(m) AS rn, MEDIAN(g) AS g FROM wx WHERE iy >= my - 2 GROUP BY 1, 2),
ls AS (SELECT unique_id, w, ARG_MAX(m, iy) AS lmean, MAX(iy) AS lyear, AVG(CASE WHEN place = 1 THEN 1.0E0 ELSE 0.0E0 END) AS pf,
  AVG(CASE WHEN place <= 3 THEN 1.0E0 ELSE 0.0E0 END) AS tf FROM wx GROUP BY 1, 2),
pk AS (SELECT *, total / NULLIF(LAG(total) OVER (PARTITION BY unique_id ORDER BY iy), 0) AS yg FROM
  (SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id, iy ORDER BY total DESC, w) AS rn FROM wx) WHERE rn = 1),
an AS (SELECT unique_id, GREATEST(LEAST(COALESCE(MEDIAN(CASE WHEN iy >= my - 2 THEN yg END), 1.0), 1.35), 0.8) AS ag, MAX(iy) AS ay, ARG_MAX(total, iy) AS atot FROM pk GROUP BY 1),
b AS (SELECT t.unique_id, x.w AS woy_week, tmean AS woy_target_mean, COALESCE(m, tmean) AS woy_profile_mean, COALESCE(md, tmean) AS woy_profile_median,
  COALESCE(sd, 0) AS woy_profile_std, COALESCE(n, 0) AS woy_profile_count, COALESCE(COALESCE(m, tmean) / NULLIF(tmean, 0), 1) AS woy_profile_ratio,
  ROUND(COALESCE(m, tmean), 10) AS rmn, COALESCE(rmean, m, tmean) AS woy_recent_mean, COALESCE(rmed, m, tmean) AS woy_recent_median,
  COALESCE(rmax, m, tmean) AS woy_recent_max, COALESCE(rc.rn, 0) AS woy_recent_count, COALESCE(lmean, m, tmean) AS woy_last_year_mean,
  COALESCE(lyear, (SELECT MAX(iy) FROM d)) AS woy_last_observed_year, GREATEST(LEAST(COALESCE(rc.g, 1.0), 1.35), 0.8) AS woy_same_week_growth,
  COALESCE(pf, 0) AS woy_peak_frequency, COALESCE(tf, 0) AS woy_top3_frequency, ag AS woy_annual_peak_growth, ay AS woy_last_peak_year,
  atot AS woy_last_annual_peak_total, atot * ag AS woy_expected_next_annual_peak, COALESCE(atot * ag / NULLIF(atot, 0), 1) AS woy_expected_peak_to_current
  FROM tm t CROSS JOIN (SELECT UNNEST(range(1, 54)) AS w) x LEFT JOIN wk ON wk.unique_id = t.unique_id AND wk.w = x.w
  LEFT JOIN rc ON rc.unique_id = t.unique_id AND rc.w = x.w LEFT JOIN ls ON ls.unique_id = t.unique_id AND ls.w = x.w JOIN an ON an.unique_id = t.unique_id),
s AS (SELECT *, (RANK() OVER (PARTITION BY unique_id ORDER BY rmn) + (COUNT(*) OVER (PARTITION BY unique_id, rmn) - 1) / 2.0E0) / 53 AS woy_profile_rank_pct,
  woy_last_year_mean * woy_same_week_growth AS woy_projected_next_mean FROM b),
p AS (SELECT *, ROUND(0.45E0 * woy_profile_rank_pct + 0.35E0 * woy_top3_frequency + 0.2E0 * woy_peak_frequency, 10) AS woy_peak_score,
  {ratio('woy_recent_mean')} AS woy_recent_to_all_ratio, {ratio('woy_last_year_mean')} AS woy_last_to_all_ratio,
  {ratio('woy_projected_next_mean')} AS woy_projected_to_all_ratio FROM s),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id ORDER BY rmn DESC, woy_week) AS woy_mean_rank_desc,
  ROW_NUMBER() OVER (PARTITION BY unique_id ORDER BY woy_peak_score DESC, woy_week) AS woy_peak_rank_desc,
  FIRST_VALUE(woy_week) OVER (PARTITION BY unique_id ORDER BY woy_peak_score DESC, rmn DESC, woy_week) AS woy_reference_peak_week FROM p)
SELECT *, CASE WHEN woy_mean_rank_desc <= 6 THEN 1 ELSE 0 END AS woy_is_top_mean_week, CASE WHEN woy_peak_rank_desc <= 6 THEN 1 ELSE 0 END AS woy_is_peak_candidate_week,
  LEAST(ABS(woy_week - woy_reference_peak_week), 53 - ABS(woy_week - woy_reference_peak_week)) AS woy_peak_distance,
  GREATEST(LEAST(1 - LEAST(ABS(woy_week - woy_reference_peak_week), 53 - ABS(woy_week - woy_reference_peak_week)) / 26.5E0, 1), 0) AS woy_peak_proximity FROM r"""


_MIX = " + ".join(f"w{i + 1} * {m}" for i, m in enumerate(MODELS))

VIEWS: dict[str, str] = {
"ser_raw": """
SELECT date AS ds, 'Revenue' AS unique_id, CAST(revenue AS DOUBLE) AS y FROM v_sales UNION ALL SELECT date, 'COGS', CAST(cogs AS DOUBLE) FROM v_sales""",
"ser_dense": """
SELECT d.ds, u.unique_id, r.y FROM (SELECT CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ds FROM (SELECT MIN(date) AS a, MAX(date) AS b FROM v_sales) e) d
CROSS JOIN (VALUES ('Revenue'), ('COGS')) u(unique_id) LEFT JOIN ser_raw r ON r.unique_id = u.unique_id AND r.ds = d.ds""",
"ser": f"""
SELECT unique_id, ds, y AS y_raw, COALESCE(y, y0 + (y1 - y0) * (CAST(rn - p0 AS DOUBLE) / (p1 - p0)), y0) AS y, CASE WHEN ds {REGIME} THEN 1 ELSE 0 END AS is_covid FROM (
  SELECT *, LAST_VALUE(y IGNORE NULLS) OVER pre AS y0, LAST_VALUE(CASE WHEN y IS NOT NULL THEN rn END IGNORE NULLS) OVER pre AS p0,
    FIRST_VALUE(y IGNORE NULLS) OVER post AS y1, FIRST_VALUE(CASE WHEN y IS NOT NULL THEN rn END IGNORE NULLS) OVER post AS p1
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM ser_dense) z
  WINDOW pre AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    post AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) x""",
"cut": "SELECT ds AS cutoff FROM (SELECT DISTINCT ds FROM ser) q ORDER BY ds DESC LIMIT 1 OFFSET 548",
"train_part": "SELECT unique_id, ds, y, is_covid FROM ser WHERE ds <= (SELECT cutoff FROM cut)",
"test_part": "SELECT unique_id, ds, y, is_covid FROM ser WHERE ds > (SELECT cutoff FROM cut)",
"prof_full": profile_sql("ser"),
"prof_train": profile_sql("train_part"),
"judged": """
SELECT e.unique_id, e.ds, e.y, COALESCE(s1, woy_profile_mean) AS seasonal_728, COALESCE(s2, woy_profile_mean) AS seasonal_735,
  COALESCE(s3, woy_profile_mean) AS seasonal_742, woy_profile_mean AS week_mean
FROM (SELECT *, LAG(y, 728) OVER l AS s1, LAG(y, 735) OVER l AS s2, LAG(y, 742) OVER l AS s3 FROM ser WINDOW l AS (PARTITION BY unique_id ORDER BY ds)) e
JOIN prof_train p ON p.unique_id = e.unique_id AND p.woy_week = WEEKOFYEAR(e.ds) WHERE e.ds > (SELECT cutoff FROM cut)""",
"mixes": "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join([str(i), *(f"{w!r}::DOUBLE" for w in map(float, row))]) + ")"
    for i, row in enumerate(weight_candidates(len(MODELS), BlendConfig()))) + ") m(candidate, w1, w2, w3, w4)",
"blend_scores": f"""
SELECT unique_id, candidate, w1, w2, w3, w4, bias, AVG(ABS(y - GREATEST(mix + bias, 0))) AS validation_mae FROM (
  SELECT unique_id, candidate, w1, w2, w3, w4, y, mix, MEDIAN(y - mix) OVER (PARTITION BY unique_id, candidate) AS bias FROM (
    SELECT e.*, m.*, {_MIX} AS mix FROM judged e CROSS JOIN mixes m) a) b GROUP BY 1, 2, 3, 4, 5, 6, 7""",
"blend_best": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id ORDER BY ROUND(validation_mae, 6), candidate) AS rn FROM blend_scores) d WHERE rn = 1""",
"judged_blend": f"""
SELECT e.*, GREATEST({_MIX} + bias, 0) AS Optimized FROM judged e JOIN blend_best b ON b.unique_id = e.unique_id""",
"fut": f"""
SELECT unique_id, ds, CASE WHEN ds {REGIME} THEN 1 ELSE 0 END AS flag FROM (SELECT DISTINCT unique_id FROM ser) u,
  (SELECT CAST(UNNEST(generate_series(m + INTERVAL 1 DAY, m + INTERVAL 548 DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM (SELECT MAX(ds) AS m FROM ser) e) d""",
"ahead": """
SELECT c.scenario, f.unique_id, f.ds, COALESCE(a.y, woy_profile_mean) * k AS seasonal_728, COALESCE(b.y, woy_profile_mean) * k AS seasonal_735,
  COALESCE(d.y, woy_profile_mean) * k AS seasonal_742, woy_profile_mean * k AS week_mean
FROM fut f JOIN prof_full p ON p.unique_id = f.unique_id AND p.woy_week = WEEKOFYEAR(f.ds)
JOIN (SELECT unique_id, AVG(CASE WHEN is_covid = 1 THEN y END) / AVG(CASE WHEN is_covid = 0 THEN y END) AS eff FROM ser GROUP BY 1) r ON r.unique_id = f.unique_id
CROSS JOIN LATERAL (SELECT 'non_covid' AS scenario, 1.0E0 AS k UNION ALL SELECT 'covid', eff UNION ALL SELECT 'auto', CASE WHEN flag = 1 THEN eff ELSE 1.0E0 END) c
LEFT JOIN ser a ON a.unique_id = f.unique_id AND a.ds = f.ds - 728 LEFT JOIN ser b ON b.unique_id = f.unique_id AND b.ds = f.ds - 735
LEFT JOIN ser d ON d.unique_id = f.unique_id AND d.ds = f.ds - 742""",
"ahead_blend": f"""
SELECT a.*, GREATEST({_MIX} + bias, 0) AS Optimized FROM ahead a JOIN blend_best b ON b.unique_id = a.unique_id""",
"mixed": """
SELECT 'blend' AS scenario, unique_id, ds, """ + ", ".join(
    f"0.5 * MAX(CASE WHEN scenario = 'non_covid' THEN {c} END) + 0.5 * MAX(CASE WHEN scenario = 'covid' THEN {c} END) AS {c}"
    for c in (*MODELS, "Optimized")) + " FROM ahead_blend GROUP BY unique_id, ds",
"submitted": "SELECT ds AS Date, " + ", ".join(
    f"ROUND_EVEN(GREATEST(MAX(CASE WHEN unique_id = '{u}' THEN Optimized END), 0), 2) AS {u}" for u in ("Revenue", "COGS"))
    + " FROM mixed GROUP BY ds",
}
MATERIALIZED = {"v_master", "v_sales", "ser", "prof_full", "prof_train", "judged", "mixes", "blend_scores", "blend_best", "ahead"}


def _lags() -> str:
    cfg = SeriesConfig()
    fn = {"mean": "AVG", "max": "MAX", "min": "MIN"}
    roll = lambda r: f"{fn[r.fn]}(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {r.lag + r.window - 1} PRECEDING AND {r.lag} PRECEDING) AS {r.name}"
    return ", ".join([f"LAG(y, {n}) OVER (PARTITION BY unique_id ORDER BY ds) AS lag{n}" for n in cfg.lags] + [roll(r) for r in cfg.rolling])


def _metrics() -> str:
    one = """SELECT unique_id, AVG(ABS(y - Optimized)) AS mae, SQRT(AVG((y - Optimized) * (y - Optimized))) AS rmse,
  1 - SUM((y - Optimized) * (y - Optimized)) / NULLIF(VAR_POP(y) * COUNT(*), 0) AS r2,
  AVG(ABS((y - Optimized) / CASE WHEN ABS(y) < 1E-8 THEN 1E-8 ELSE y END)) * 100 AS mape_pct,
  AVG(CASE WHEN ABS(y) < 1E-8 THEN 1.0E0 ELSE 0.0E0 END) AS guarded_share, COUNT(*) AS days FROM judged_blend GROUP BY 1"""
    return f"""SELECT * FROM ({one}) a UNION ALL SELECT 'Average', AVG(mae), AVG(rmse), AVG(r2), AVG(mape_pct), AVG(guarded_share), SUM(days) FROM ({one}) b"""


SQL: dict[str, str] = {
    "load_series": "SELECT unique_id, ds, y, is_covid FROM ser",
    "interpolate_gaps": "SELECT unique_id, ds, y_raw, y FROM ser",
    "regime_flag": "SELECT DISTINCT ds, is_covid AS by_date, 0 AS forced_off, 1 AS forced_on FROM ser",
    "covid_summary": "SELECT is_covid, MIN(ds) AS first_day, MAX(ds) AS last_day, COUNT(DISTINCT ds) AS days FROM ser GROUP BY 1",
    "temporal_split": "SELECT unique_id, ds, y, CASE WHEN ds <= (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS part FROM ser",
    "future_frame": """SELECT 'non_covid' AS scenario, unique_id, ds, 0 AS is_covid FROM fut UNION ALL SELECT 'covid', unique_id, ds, 1 FROM fut
UNION ALL SELECT 'auto', unique_id, ds, flag FROM fut""",
    "calendar_features": f"SELECT DISTINCT ds, {CALENDAR} FROM ser",
    "week_harmonics": f"SELECT DISTINCT ds, {HARMONICS} FROM ser",
    "week_onehot": f"SELECT DISTINCT ds, {ONEHOT} FROM ser",
    "woy_profile": "SELECT * FROM prof_full",
    "woy_profile_base": "SELECT * FROM prof_full",
    "woy_recent": "SELECT * FROM prof_full",
    "woy_growth": "SELECT * FROM prof_full",
    "woy_peak": "SELECT * FROM prof_full",
    "woy_annual": "SELECT * FROM prof_full",
    "profile_leakage": """SELECT t.unique_id, t.woy_week, t.woy_profile_mean AS train_mean, f.woy_profile_mean AS full_mean, t.woy_profile_count AS train_days, f.woy_profile_count AS full_days
FROM prof_train t JOIN prof_full f ON f.unique_id = t.unique_id AND f.woy_week = t.woy_week""",
    "weekly_peak_preview": "SELECT * FROM prof_train WHERE woy_peak_rank_desc <= 6",
    "annual_peak_note": """
SELECT * FROM (SELECT unique_id, iso_year, woy_week, weekly_mean, weekly_mean / LAG(weekly_mean) OVER (PARTITION BY unique_id ORDER BY iso_year) AS peak_yoy_growth FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id, iso_year ORDER BY ROUND(weekly_mean, 6) DESC, woy_week) AS rn FROM (
    SELECT unique_id, ISOYEAR(ds) AS iso_year, WEEKOFYEAR(ds) AS woy_week, AVG(y) AS weekly_mean FROM ser GROUP BY 1, 2, 3) a) b WHERE rn = 1) c
WHERE iso_year BETWEEN 1998 AND 2000""",
    "feature_matrix": f"""
SELECT f.*, {CALENDAR}, {HARMONICS}, {ONEHOT}, p.* EXCLUDE (unique_id) FROM (SELECT * FROM (SELECT unique_id, ds, y, is_covid, {_lags()} FROM ser) l WHERE lag365 IS NOT NULL) f
JOIN prof_full p ON p.unique_id = f.unique_id AND p.woy_week = WEEKOFYEAR(f.ds)""",
    "baseline_forecast": "SELECT * FROM judged",
    "model_mae": " UNION ALL ".join(f"SELECT '{m}' AS model, unique_id, AVG(ABS(y - {m})) AS mae FROM judged GROUP BY 2" for m in MODELS),
    "blend_search": "SELECT * FROM blend_best",
    "blend_candidates": "SELECT * FROM blend_scores",
    "seeded_sample": f"""SELECT unique_id, ds, y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM ser) z
  WHERE rn > {max(SeriesConfig().lags)} ORDER BY md5(unique_id || ':' || ds::VARCHAR || ':42'), unique_id, ds LIMIT 2000""",
    "apply_blend": "SELECT unique_id, ds, y, Optimized FROM judged_blend",
    "forecast_metrics": _metrics(),
    "scenario_blend": "SELECT * FROM mixed",
    "submission_wide": "SELECT * FROM submitted",
    "export_roundtrip": "SELECT * FROM submitted",
    "contract_check": "SELECT MIN(Date) AS first_day, MAX(Date) AS last_day, COUNT(*) AS rows, COUNT(DISTINCT Date) AS days FROM submitted",
    "history_vs_forecast": """SELECT 'history' AS kind, ds AS Date, MAX(CASE WHEN unique_id = 'Revenue' THEN y END) AS Revenue, MAX(CASE WHEN unique_id = 'COGS' THEN y END) AS COGS
FROM ser GROUP BY 2 UNION ALL SELECT 'forecast', Date, Revenue, COGS FROM submitted""",
}
