"""DuckDB SQL for every registered query, over the same parquet tables.

The SQL is written independently of the Spark code: plain window functions
(one partition per user is fine for a small oracle), self equi-joins for lag
sums, ``regr_*`` aggregates for regressions. Shared steps are CTEs.
"""

from __future__ import annotations

import math

from ..sources.adapter import ORACLE_TRACE_CTE


def with_ctes(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + final


def _fold(name: str, src: str, keys: str) -> str:
    piv = lambda cond: f"max(CASE WHEN {cond} THEN \"timestamp\" ELSE 0 END)"
    return f"""
{name}_fold AS (
  SELECT {keys},
    {piv('evtype = 0')} AS arrive, {piv('evtype = 1')} AS schedule, {piv('evtype = 4')} AS finish,
    {piv('evtype = 2')} AS evict, {piv('evtype = 3')} AS fail, {piv('evtype = 5')} AS kill,
    {piv('evtype = 6')} AS lost, {piv('evtype IN (2, 3, 5, 6)')} AS generalfailure
  FROM {src} GROUP BY {keys}
),
{name} AS (
  SELECT {keys}, arrive, schedule, finish, evict, fail, kill, lost, generalfailure,
    CASE WHEN schedule <= finish THEN finish - schedule ELSE -1 END AS size,
    CASE WHEN schedule >= arrive THEN schedule - arrive ELSE -1 END AS waittime
  FROM {name}_fold
  WHERE arrive > 0 AND (schedule = 0 OR arrive < schedule) AND (finish = 0 OR schedule < finish)
)"""


TASK_LC = _fold("task_lc", "task_ev", "jobid, taskix")
JOB_LC = _fold("job_lc", "job_ev", "jobid")
LC_COLS = "arrive, schedule, finish, evict, fail, kill, lost, generalfailure, size, waittime"

TASK_LC_META = f"""
task_meta AS (
  SELECT t.jobid, t.taskix, {', '.join('t.' + c for c in LC_COLS.split(', '))},
         e.machineid, e.username, e.sclass, e.priority, e.cpureq, e.ramreq, e.hdreq
  FROM task_lc t JOIN task_ev e ON e.jobid = t.jobid AND e.taskix = t.taskix AND e.evtype = 0
)"""

JOB_LC_META = f"""
job_meta AS (
  SELECT j.jobid, {', '.join('j.' + c for c in LC_COLS.split(', '))}, e.username, e.sclass
  FROM job_lc j JOIN job_ev e ON e.jobid = j.jobid AND e.evtype = 0
)"""

TRACE = ORACLE_TRACE_CTE
BASE = (TRACE, TASK_LC, JOB_LC)
BASE_META = (TRACE, TASK_LC, JOB_LC, TASK_LC_META, JOB_LC_META)


def lifecycle_sql() -> dict[str, str]:
    return {
        "task_event_counts": with_ctes(
            TRACE, final="SELECT evtype, count(*) AS count FROM task_ev GROUP BY evtype"),
        "job_event_counts": with_ctes(
            TRACE, final="SELECT evtype, count(*) AS count FROM job_ev GROUP BY evtype"),
        "task_lifecycle": with_ctes(*BASE, final="SELECT * FROM task_lc"),
        "job_lifecycle": with_ctes(*BASE, final="SELECT * FROM job_lc"),
        "task_lifecycle_meta": with_ctes(*BASE_META, final="SELECT * FROM task_meta"),
        "job_lifecycle_meta": with_ctes(*BASE_META, final="SELECT * FROM job_meta"),
        "task_meta_join": with_ctes(*BASE, final="""
SELECT t.jobid, t.taskix, t.arrive, t.schedule, t.finish, t.fail, t.size, t.waittime,
       e.machineid, e.username, e.sclass, e.priority, e.cpureq, e.ramreq, e.hdreq
FROM task_lc t JOIN task_ev e ON e.jobid = t.jobid AND e.taskix = t.taskix AND e.evtype = 0"""),
        "job_meta_join": with_ctes(*BASE, final="""
SELECT j.jobid, j.arrive, j.schedule, j.evict, j.fail, j.kill, j.lost, j.generalfailure,
       j.size, j.waittime, e.username, e.sclass
FROM job_lc j JOIN job_ev e ON e.jobid = j.jobid AND e.evtype = 0
WHERE j.fail = 0"""),
    }


def summary_sql() -> dict[str, str]:
    prof = " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS rows FROM {t}"
        for n, t in [("task_events", "task_ev"), ("job_events", "job_ev"), ("task_lifecycle", "task_lc"),
                     ("job_lifecycle", "job_lc"), ("task_lifecycle_meta", "task_meta"),
                     ("job_lifecycle_meta", "job_meta")]
    )
    hist = """
hv AS (SELECT CAST(size AS DOUBLE) AS v FROM task_meta WHERE size IS NOT NULL),
hs AS (SELECT min(v) AS lo, max(v) AS hi, CASE WHEN max(v) = min(v) THEN 1 ELSE 5 END AS nb FROM hv),
hb AS (SELECT CASE WHEN hs.hi = hs.lo THEN 0
                   ELSE least(CAST(floor((hv.v - hs.lo) / (hs.hi - hs.lo) * 5.0) AS INTEGER), 4) END AS bucket
       FROM hv, hs),
hc AS (SELECT bucket, count(*) AS count FROM hb GROUP BY bucket),
hg AS (SELECT CAST(range AS INTEGER) AS bucket FROM range(5))"""
    return {
        "csv_task_events": with_ctes(TRACE, final="SELECT * FROM task_ev"),
        "csv_job_events": with_ctes(TRACE, final="SELECT * FROM job_ev"),
        "trace_profile": with_ctes(*BASE_META, final=prof),
        "files_profile": with_ctes(*BASE_META, final=prof),
        "size_histogram": with_ctes(*BASE_META, hist, final="""
SELECT hg.bucket, hs.lo + hg.bucket * ((hs.hi - hs.lo) / 5.0) AS lo,
       CASE WHEN hg.bucket = hs.nb - 1 THEN hs.hi ELSE hs.lo + (hg.bucket + 1) * ((hs.hi - hs.lo) / 5.0) END AS hi,
       coalesce(hc.count, 0) AS count
FROM hg CROSS JOIN hs LEFT JOIN hc ON hc.bucket = hg.bucket
WHERE hg.bucket < hs.nb"""),
    }


HEAVY = 100
MUS_SQL = "(VALUES " + ", ".join(f"(CAST({m} AS DOUBLE))" for m in (1.2, 1.4, 1.6, 2.0, 3.0, 4.0, 5.0, 6.0)) + ") mus(mu)"

PROC = f"""
jobs_ok AS (SELECT * FROM job_meta WHERE fail = 0),
heavy AS (SELECT username, count(*) AS count FROM jobs_ok GROUP BY username HAVING count(*) > {HEAVY}),
arr_seq AS (
  SELECT username, arrive,
         row_number() OVER (PARTITION BY username ORDER BY arrive, jobid) - 1 AS k,
         arrive - lag(arrive, 1, 0) OVER (PARTITION BY username ORDER BY arrive, jobid) AS raw
  FROM jobs_ok WHERE username IN (SELECT username FROM heavy)
),
arr_st AS (SELECT username, count(*) - 1 AS n, min(arrive) AS lo, max(arrive) AS hi
           FROM arr_seq GROUP BY username HAVING count(*) > 1),
arr AS (
  SELECT s.username, s.k - 1 AS idx, s.raw,
         s.raw / (1.0 * CAST((t.hi - t.lo) // t.n AS DOUBLE)) AS x,
         s.arrive - s.raw - t.lo AS pre, t.n AS n, 1.0 * CAST((t.hi - t.lo) // t.n AS DOUBLE) AS c,
         CAST(0 AS BIGINT) AS r0
  FROM arr_seq s JOIN arr_st t USING (username) WHERE s.k >= 1
),
svc_rank AS (
  SELECT username, jobid, arrive, size, row_number() OVER (PARTITION BY jobid ORDER BY taskix) AS rk
  FROM task_meta WHERE size >= 0 AND username IN (SELECT username FROM heavy)
),
svc_seq AS (
  SELECT username, jobid, arrive, size,
         first_value(size) OVER (PARTITION BY username ORDER BY arrive, jobid) AS r0,
         row_number() OVER (PARTITION BY username ORDER BY arrive, jobid) - 1 AS idx,
         coalesce(sum(size) OVER (PARTITION BY username ORDER BY arrive, jobid
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
  FROM svc_rank WHERE rk = 1
),
svc_st AS (SELECT username, count(*) AS n, sum(size) AS s FROM svc_seq GROUP BY username),
svc AS (
  SELECT q.username, q.idx, q.size AS raw, q.size / (1.0 * CAST(t.s // t.n AS DOUBLE)) AS x,
         CAST(q.pre AS BIGINT) AS pre, t.n AS n, CAST(t.s AS DOUBLE) / t.n AS mean_raw,
         1.0 * CAST(t.s // t.n AS DOUBLE) AS c, q.r0
  FROM svc_seq q JOIN svc_st t USING (username)
),
tia_seq AS (
  SELECT username,
         row_number() OVER (PARTITION BY username ORDER BY arrive, jobid, taskix) - 2 AS idx,
         arrive - lag(arrive) OVER (PARTITION BY username ORDER BY arrive, jobid, taskix) AS interarrival
  FROM task_meta WHERE username IN (SELECT username FROM heavy)
),
tia AS (SELECT * FROM tia_seq WHERE idx >= 0)"""

ANALYSIS = (*BASE_META, PROC)


def process_sql() -> dict[str, str]:
    return {
        "heavy_users": with_ctes(*ANALYSIS, final="SELECT * FROM heavy"),
        "heavy_users_ranked": with_ctes(*ANALYSIS, final="""
SELECT CAST(row_number() OVER (ORDER BY count DESC, username) AS INTEGER) AS place, username, count
FROM (SELECT username, count(*) AS count FROM jobs_ok GROUP BY username HAVING count(*) > 235) h"""),
        "jobs_per_user": with_ctes(*ANALYSIS, final="SELECT username, count(*) AS count FROM jobs_ok GROUP BY username"),
        "arrival_process": with_ctes(*ANALYSIS, final="SELECT username, idx, raw, x FROM arr"),
        "service_process": with_ctes(*ANALYSIS, final="SELECT username, idx, raw, x FROM svc"),
        "renormalized_services": with_ctes(*ANALYSIS, final=f"""
SELECT username, mu, idx, raw, raw / (mu * mean_raw) AS x FROM svc CROSS JOIN {MUS_SQL}"""),
        "normalized_arrivals": with_ctes(*ANALYSIS, """
na AS (SELECT s.username, s.arrive, s.raw FROM arr_seq s JOIN arr_st t USING (username) WHERE s.arrive > t.lo),
na_m AS (SELECT username, avg(raw) AS m FROM na GROUP BY username)""", final="""
SELECT na.username, na.arrive, na.raw AS interarrival, na.raw / (1.0 * na_m.m) AS interarrivalN
FROM na JOIN na_m USING (username)"""),
        "normalized_services": with_ctes(*ANALYSIS, """
ns AS (SELECT username, arrive, size FROM task_meta
       WHERE fail = 0 AND taskix = 0 AND username IN (SELECT username FROM heavy)),
ns_m AS (SELECT username, avg(size) AS m FROM ns GROUP BY username)""", final="""
SELECT ns.username, ns.arrive, ns.size, ns.size / (1.0 * ns_m.m) AS sizeN FROM ns JOIN ns_m USING (username)"""),
        "task_interarrivals": with_ctes(*ANALYSIS, final="SELECT username, idx, interarrival FROM tia"),
        "arrival_autocorr": with_ctes(*ANALYSIS, """
tm AS (SELECT username, avg(interarrival) AS m FROM tia GROUP BY username),
tc AS (SELECT t.username, t.idx, t.interarrival - tm.m AS y FROM tia t JOIN tm USING (username)),
den AS (SELECT username, sum(y * y) AS d FROM tc GROUP BY username),
lags AS (SELECT CAST(range AS INTEGER) AS lag FROM range(1, 101)),
num AS (SELECT a.username, l.lag, sum(a.y * b.y) AS s
        FROM tc a CROSS JOIN lags l JOIN tc b ON b.username = a.username AND b.idx = a.idx + l.lag
        GROUP BY a.username, l.lag)""", final="""
SELECT num.username, num.lag, round(num.s / den.d, 9) AS acf FROM num JOIN den USING (username)"""),
    }


MAX_L = 40


def theta_values(pairs) -> str:
    return "(VALUES " + ", ".join(f"({k}, CAST({t} AS DOUBLE))" for k, t in pairs) + ") th(tkey, theta0)"


def mgf_curve_cte(name: str, src: str, kind: str, semantics: str, thetas, max_l: int = MAX_L) -> str:
    """CTE ``name`` (username, tkey, theta, lag, mgf) over valid lags, naive self-join."""
    if semantics == "reference":
        a, b, r0 = (0, 1, "") if kind == "arrival" else (1, 2, "p.r0 + ")
    else:
        a, b, r0 = (0, 0, "") if kind == "arrival" else (0, 1, "")
    gap = max_l if kind == "arrival" else max_l + 1
    sign = "-abs(th.theta0)" if kind == "arrival" else "abs(th.theta0)"
    cut = 1 if semantics == "reference" else 0
    return f"""
{name}_x AS (
  SELECT p.username, l.lag, p.c, {r0}q.pre - p.pre AS x
  FROM {src} p CROSS JOIN (SELECT CAST(range AS INTEGER) AS lag FROM range(1, {max_l})) l
  JOIN {src} q ON q.username = p.username AND q.idx = p.idx - {a} + l.lag + {b}
  WHERE p.idx - {a} >= 0 AND p.idx - {a} < p.n - {gap}
),
{name}_agg AS (
  SELECT x.username, th.tkey, {sign} AS theta, x.lag, avg(exp({sign} / x.c * x.x)) AS mgf
  FROM {name}_x x CROSS JOIN {theta_values(thetas)}
  GROUP BY x.username, th.tkey, th.theta0, x.lag
),
{name}_b AS (
  SELECT *, coalesce(min(CASE WHEN mgf = 0 OR isinf(mgf) OR isnan(mgf) THEN lag END)
                     OVER (PARTITION BY username, tkey), {max_l}) AS b
  FROM {name}_agg
),
{name} AS (SELECT username, tkey, theta, lag, mgf, ln(mgf) / theta AS logmgf FROM {name}_b WHERE lag < b - {cut})"""


def lagsum_sql() -> dict[str, str]:
    th = [(0, 0.5), (1, 0.9)]
    return {
        "sliding_sum": with_ctes(*ANALYSIS, final="""
SELECT p.username, p.idx, round((q.pre - p.pre) / p.c, 9) AS lagsum
FROM arr p JOIN arr q ON q.username = p.username AND q.idx = p.idx + 20"""),
        "lag_sums": with_ctes(*ANALYSIS, final=f"""
SELECT p.username, l.lag, p.idx, round((q.pre - p.pre) / p.c, 9) AS lagsum
FROM arr p CROSS JOIN (SELECT CAST(range AS INTEGER) AS lag FROM range(0, {MAX_L})) l
JOIN arr q ON q.username = p.username AND q.idx = p.idx + l.lag + 1
WHERE p.idx < p.n - {MAX_L}"""),
        "mgf_single_lag": with_ctes(*ANALYSIS, """
sl AS (
  SELECT 'arrival' AS kind, p.username, CAST(-0.5 AS DOUBLE) AS theta, p.c, q.pre - p.pre AS x
  FROM arr p JOIN arr q ON q.username = p.username AND q.idx = p.idx + 20
  UNION ALL
  SELECT 'service' AS kind, p.username, CAST(0.5 AS DOUBLE) AS theta, p.c, q.pre - p.pre AS x
  FROM svc p JOIN svc q ON q.username = p.username AND q.idx = p.idx + 21
)""", final="""
SELECT username, kind, theta, round(ln(avg(exp(theta / c * x))) / theta, 6) AS logmgf
FROM sl GROUP BY username, kind, theta"""),
        "mgf_curve_arrival": with_ctes(*ANALYSIS, mgf_curve_cte("ca", "arr", "arrival", "reference", th),
                                       final="SELECT username, theta, lag, round(logmgf, 6) AS logmgf FROM ca"),
        "mgf_curve_service": with_ctes(*ANALYSIS, mgf_curve_cte("cs", "svc", "service", "reference", th),
                                       final="SELECT username, theta, lag, round(logmgf, 6) AS logmgf FROM cs"),
        "mgf_curve_documented": with_ctes(
            *ANALYSIS,
            mgf_curve_cte("da", "arr", "arrival", "documented", [(0, 0.5)]),
            mgf_curve_cte("ds", "svc", "service", "documented", [(0, 0.5)]),
            final="""
SELECT 'arrival' AS kind, username, theta, lag, round(logmgf, 6) AS logmgf FROM da
UNION ALL
SELECT 'service' AS kind, username, theta, lag, round(logmgf, 6) AS logmgf FROM ds"""),
    }


def linearity_sql() -> dict[str, str]:
    from ..operators.linearity import theta_grid

    grid = list(enumerate(theta_grid(False)))
    curves = (
        mgf_curve_cte("la", "arr", "arrival", "reference", grid),
        mgf_curve_cte("ls", "svc", "service", "reference", grid),
        """lc AS (SELECT 'arrival' AS kind, * FROM la UNION ALL SELECT 'service' AS kind, * FROM ls)""",
    )
    w = int(0.25 * MAX_L)
    return {
        "linearity_r2": with_ctes(*ANALYSIS, *curves, final="""
SELECT username, kind, theta,
       round(CASE WHEN count(*) <= 10 THEN 0.0 ELSE regr_r2(logmgf, CAST(lag AS DOUBLE)) END, 6) AS r2
FROM lc GROUP BY username, kind, tkey, theta"""),
        "linearity_span": with_ctes(*ANALYSIS, *curves, f"""
lw AS (
  SELECT username, kind, tkey, theta,
         count(*) OVER (PARTITION BY username, kind, tkey) AS len,
         row_number() OVER (PARTITION BY username, kind, tkey ORDER BY lag) - 1 AS pos,
         regr_slope(logmgf, CAST(lag AS DOUBLE)) OVER (PARTITION BY username, kind, tkey ORDER BY lag
                                                      ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS b
  FROM lc
),
lm AS (
  SELECT username, kind, tkey, theta, max(len) AS len,
         min(CASE WHEN pos < len - {w} THEN b END) AS mn, max(CASE WHEN pos < len - {w} THEN b END) AS mx
  FROM lw GROUP BY username, kind, tkey, theta
),
lz AS (
  SELECT username, kind, theta,
         CASE WHEN len < {w + 10} THEN 0.0 ELSE mn END AS min_b,
         CASE WHEN len < {w + 10} THEN 0.0 ELSE mx END AS max_b
  FROM lm
)""", final="""
SELECT username, kind, theta, round(min_b, 6) AS min_b, round(max_b, 6) AS max_b,
       round(atan(max_b) - atan(min_b), 6) AS angle
FROM lz"""),
    }


CROSS_LAGS = (1, 20, 40)


def crossing_cte(arr: str = "arr", svc: str = "svc", variant: str = "lag", lags=CROSS_LAGS) -> tuple[str, ...]:
    """Recursive CTE ``cx_final`` (username, mu, l, theta, found): one bisection
    step per recursion level, means from correlated aggregates."""
    if variant == "lag":
        sx, right, adiv, sdiv = 1, "10.0 - 1e-5", "CAST(l AS DOUBLE)", "CAST(l + 1 AS DOUBLE)"
    else:
        sx, right, adiv, sdiv = 0, "1.0 - 1e-5", "1.0", "1.0"
    lag_list = ", ".join(f"({x})" for x in lags)
    wa = f"""
cx_lags AS (SELECT * FROM (VALUES {lag_list}) t(l)),
cx_a AS (SELECT p.username, g.l, CAST(q.pre - p.pre AS DOUBLE) AS xsum, p.c
         FROM {arr} p CROSS JOIN cx_lags g JOIN {arr} q ON q.username = p.username AND q.idx = p.idx + g.l),
cx_s AS (SELECT p.username, mus.mu, g.l, CAST(q.pre - p.pre AS DOUBLE) AS xsum, mus.mu * p.mean_raw AS c
         FROM {svc} p CROSS JOIN cx_lags g CROSS JOIN {MUS_SQL}
         JOIN {svc} q ON q.username = p.username AND q.idx = p.idx + g.l + {sx}),
cx_keys AS (SELECT DISTINCT a.username, mus.mu, g.l FROM {arr} a JOIN {svc} s ON s.username = a.username
            CROSS JOIN {MUS_SQL} CROSS JOIN cx_lags g)"""
    mm = lambda th: f"""
           (SELECT avg(exp(-{th} / a.c * a.xsum)) FROM cx_a a WHERE a.username = k.username AND a.l = k.l) AS mma,
           (SELECT avg(exp({th} / s.c * s.xsum)) FROM cx_s s
             WHERE s.username = k.username AND s.mu = k.mu AND s.l = k.l) AS mms"""  # noqa: E731
    rec = f"""
cx(username, mu, l, lt, rt, theta, rhoa, rhos, ct, last, found, done) AS (
  SELECT username, mu, l, lt, rt, theta, rhoa, rhos, ct, last, found,
         NOT (coalesce(abs(rhoa - rhos) > 1e-4 AND NOT isnan(abs(rhoa - rhos)), false) AND ct < 5000) AS done
  FROM (
    SELECT username, mu, l, 1e-10 AS lt, {right} AS rt, 1e-10 AS theta,
           CASE WHEN mma = 0 THEN 'inf'::DOUBLE ELSE ln(mma) / (-1e-10 * {adiv}) END AS rhoa,
           ln(mms) / (1e-10 * {sdiv}) AS rhos, 0 AS ct, 1e-10 AS last, false AS found
    FROM (SELECT k.username, k.mu, k.l, {mm('1e-10')} FROM cx_keys k) i0
  ) i1
  UNION ALL
  SELECT username, mu, l, lt, rt, theta, rhoa, rhos, ct, last, found,
         NOT (coalesce(abs(rhoa - rhos) > 1e-4 AND NOT isnan(abs(rhoa - rhos)), false) AND ct < 5000) AS done
  FROM (
    SELECT username, mu, l, lt, rt, nt AS theta, rhoa, rhos,
           CASE WHEN abs(nt - last) < 1e-10 THEN 5000 ELSE ct + 1 END AS ct, nt AS last, found
    FROM (
      SELECT username, mu, l, lt, rt, rhoa, rhos, ct, last, found,
             exp((ln(rt) + ln(lt)) / 2) AS nt
      FROM (
        SELECT username, mu, l, ct, last,
               CASE WHEN go_right THEN lt0 ELSE theta END AS lt,
               CASE WHEN go_right THEN theta ELSE rt0 END AS rt,
               CASE WHEN bad THEN rhoa0 ELSE ra END AS rhoa,
               CASE WHEN bad THEN rhos0 ELSE rs END AS rhos,
               found0 OR (NOT bad AND coalesce(rs > ra AND NOT isnan(rs) AND NOT isnan(ra), false)) AS found
        FROM (
          SELECT *, bad OR coalesce(rs > ra AND NOT isnan(rs) AND NOT isnan(ra), false) AS go_right
          FROM (
            SELECT username, mu, l, lt AS lt0, rt AS rt0, theta, rhoa AS rhoa0, rhos AS rhos0, ct, last,
                   found AS found0,
                   coalesce(mma = 0 OR isinf(mms), false) AS bad,
                   ln(mma) / (-theta * {adiv}) AS ra, ln(mms) / (theta * {sdiv}) AS rs
            FROM (SELECT k.*, {mm('k.theta')} FROM cx k WHERE NOT k.done) e0
          ) e1
        ) e2
      ) e3
    ) e4
  ) e5
),
cx_final AS (SELECT username, mu, l, theta, found FROM cx WHERE done)"""
    return (wa, rec)


NORM_PROC = """
na_rows AS (
  SELECT s.username, s.arrive, s.raw, row_number() OVER (PARTITION BY s.username ORDER BY s.arrive, s.k) - 1 AS idx,
         coalesce(sum(s.raw) OVER (PARTITION BY s.username ORDER BY s.arrive, s.k
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
  FROM arr_seq s JOIN arr_st t USING (username) WHERE s.arrive > t.lo
),
na_p AS (
  SELECT r.username, r.idx, r.raw, CAST(r.pre AS BIGINT) AS pre, 1.0 * m.mean_raw AS c, m.mean_raw
  FROM na_rows r JOIN (SELECT username, avg(raw) AS mean_raw FROM na_rows GROUP BY username) m USING (username)
),
ns_rows AS (
  SELECT username, size AS raw,
         row_number() OVER (PARTITION BY username ORDER BY arrive, jobid, taskix) - 1 AS idx,
         coalesce(sum(size) OVER (PARTITION BY username ORDER BY arrive, jobid, taskix
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
  FROM task_meta WHERE fail = 0 AND taskix = 0 AND username IN (SELECT username FROM heavy)
),
ns_p AS (
  SELECT r.username, r.idx, r.raw, CAST(r.pre AS BIGINT) AS pre, m.mean_raw AS c, m.mean_raw
  FROM ns_rows r JOIN (SELECT username, avg(raw) AS mean_raw FROM ns_rows GROUP BY username) m USING (username)
)"""


SLOPE_LAGS, SLOPE_MUS, SLOPE_WINDOW = (1, 20), (1.2, 2.0), 20
DEFAULT_MUS = (1.2, 1.4, 1.6, 2.0, 3.0, 4.0, 5.0, 6.0)
GRID_THETAS = tuple(t * 0.98 ** i for i in range(11) for t in (0.1, 0.2, 0.3))


def slope_cte(slope_lags=SLOPE_LAGS, slope_mus=SLOPE_MUS) -> tuple[str, ...]:
    """Recursive CTE ``sl_final`` (username, mu, l, theta, found): one bisection step per
    recursion level; the rates are ``regr_slope`` of the naive log-MGF curves at that theta."""
    lags = ", ".join(f"({x})" for x in slope_lags)
    mus = ", ".join(f"(CAST({m} AS DOUBLE))" for m in slope_mus)
    sums = f"""
sl_l AS (SELECT l, CAST(l + o.range AS INTEGER) AS lag, l + {SLOPE_WINDOW} AS top
         FROM (VALUES {lags}) t(l) CROSS JOIN range(0, {SLOPE_WINDOW}) o),
sl_a AS (SELECT p.username, g.l, g.lag, CAST(q.pre - p.pre AS DOUBLE) AS x, p.c
         FROM arr p CROSS JOIN sl_l g JOIN arr q ON q.username = p.username AND q.idx = p.idx + g.lag + 1
         WHERE p.idx < p.n - g.top),
sl_s AS (SELECT p.username, g.l, g.lag, CAST(p.r0 + q.pre - p.pre AS DOUBLE) AS x, p.mean_raw
         FROM svc p CROSS JOIN sl_l g JOIN svc q ON q.username = p.username AND q.idx = p.idx + g.lag + 1
         WHERE p.idx >= 1 AND p.idx - 1 < p.n - g.top - 1),
sl_keys AS (SELECT DISTINCT a.username, m.mu, g.l FROM arr a JOIN svc s ON s.username = a.username
            CROSS JOIN (VALUES {mus}) m(mu) CROSS JOIN (SELECT DISTINCT l FROM sl_l) g)"""

    def rates(source: str) -> str:
        """username, mu, l, bad, ra, rs of every row of ``source`` (username, mu, l, theta)."""
        side = lambda name, table, theta, scale: f"""
           {name}_m AS (SELECT k.username, k.mu, k.l, x.lag, {theta} AS t, avg(exp({theta} / {scale} * x.x)) AS mgf
                    FROM k JOIN {table} x ON x.username = k.username AND x.l = k.l GROUP BY k.username, k.mu, k.l, k.theta, x.lag),
           {name}_b AS (SELECT *, coalesce(min(CASE WHEN mgf = 0 OR isinf(mgf) OR isnan(mgf) THEN lag END)
                          OVER (PARTITION BY username, mu, l), l + {SLOPE_WINDOW}) AS b FROM {name}_m),
           {name} AS (SELECT username, mu, l, count(*) AS n, regr_slope(ln(mgf) / t, CAST(lag AS DOUBLE)) AS slope
                  FROM {name}_b WHERE lag < b - 1 GROUP BY username, mu, l)"""  # noqa: E731
        return f"""(WITH k AS ({source}),{side('ca', 'sl_a', '-k.theta', 'x.c')},{side('cs', 'sl_s', 'k.theta', '(k.mu * x.mean_raw)')}
         SELECT k.username, k.mu, k.l, coalesce(ca.n, 0) < 10 OR coalesce(cs.n, 0) < 10 AS bad, ca.slope AS ra, cs.slope AS rs
         FROM k LEFT JOIN ca USING (username, mu, l) LEFT JOIN cs USING (username, mu, l))"""

    rec = f"""
sl(username, mu, l, lt, rt, theta, rhoa, rhos, ct, last, found, done) AS (
  SELECT username, mu, l, 1e-10, 10.0 - 1e-5, 1e-10, ra, rs, 0, 1e-10, false,
         NOT coalesce(abs(ra - rs) > 1e-4 AND NOT isnan(abs(ra - rs)), false)
  FROM {rates("SELECT username, mu, l, CAST(1e-10 AS DOUBLE) AS theta FROM sl_keys")} r0
  UNION ALL
  SELECT username, mu, l, lt, rt, nt, rhoa, rhos, CASE WHEN abs(nt - last) < 1e-10 THEN 5000 ELSE ct + 1 END, nt, found,
         NOT (coalesce(abs(rhoa - rhos) > 1e-4 AND NOT isnan(abs(rhoa - rhos)), false) AND NOT abs(nt - last) < 1e-10 AND ct + 1 < 5000)
  FROM (
    SELECT *, exp((ln(rt) + ln(lt)) / 2) AS nt
    FROM (
      SELECT username, mu, l, ct, last, CASE WHEN go_right THEN lt0 ELSE theta END AS lt, CASE WHEN go_right THEN theta ELSE rt0 END AS rt,
             CASE WHEN bad THEN rhoa0 ELSE ra END AS rhoa, CASE WHEN bad THEN rhos0 ELSE rs END AS rhos,
             found0 OR (NOT bad AND coalesce(rs > ra, false)) AS found
      FROM (
        SELECT o.username, o.mu, o.l, o.lt AS lt0, o.rt AS rt0, o.theta, o.rhoa AS rhoa0, o.rhos AS rhos0, o.ct, o.last, o.found AS found0,
               r.bad, r.ra, r.rs, r.bad OR coalesce(r.rs > r.ra, false) AS go_right
        FROM sl o JOIN {rates("SELECT username, mu, l, theta FROM sl WHERE NOT done")} r USING (username, mu, l)
        WHERE NOT o.done
      ) e1
    ) e2
  ) e3
),
sl_final AS (SELECT username, mu, l, theta, found FROM sl WHERE done)"""
    return (sums, rec)


def crossing_sql() -> dict[str, str]:
    final = "SELECT username, mu, l, round(ln(theta), 6) AS ln_theta, found FROM cx_final"
    wa, rec = crossing_cte()
    sql = with_ctes(*ANALYSIS, wa, rec, final=final)
    wa1, rec1 = crossing_cte("na_p", "ns_p", "single_window")
    sql1 = with_ctes(*ANALYSIS, NORM_PROC, wa1, rec1, final=final)
    slope = lambda *grid: with_ctes(*ANALYSIS, *slope_cte(*grid), final=(
        "SELECT username, mu, l, round(ln(theta), 6) AS ln_theta, found FROM sl_final")).replace("WITH ", "WITH RECURSIVE ", 1)
    return {"crossing_theta_slope": slope(),
            "crossing_theta_slope_grid": slope(CROSS_LAGS, DEFAULT_MUS),
            "crossing_theta": sql.replace("WITH ", "WITH RECURSIVE ", 1),
            "crossing_theta_single_window": sql1.replace("WITH ", "WITH RECURSIVE ", 1)}


LN_EPS = math.log(1e-6)
LN_K = math.log(16.0)


def cand_curves_cte(cand: str, semantics: str = "reference", max_l: int = MAX_L) -> str:
    """CTE ``cc`` (username, mu, cand, theta, kind, p, f) from a candidate CTE
    (username, mu, cand, theta): both log-MGF curves, naive self-join."""
    ref = semantics == "reference"
    a_off, s_a, s_b, r0 = (1, 1, 2, "p.r0 + ") if ref else (0, 0, 1, "")
    cut = 1 if ref else 0
    return f"""
cc_lags AS (SELECT CAST(range AS INTEGER) AS lag FROM range(1, {max_l})),
cc_xa AS (
  SELECT p.username, l.lag, p.c, CAST(q.pre - p.pre AS DOUBLE) AS x
  FROM arr p CROSS JOIN cc_lags l JOIN arr q ON q.username = p.username AND q.idx = p.idx + l.lag + {a_off}
  WHERE p.idx < p.n - {max_l}
),
cc_xs AS (
  SELECT p.username, l.lag, p.mean_raw, CAST({r0}q.pre - p.pre AS DOUBLE) AS x
  FROM svc p CROSS JOIN cc_lags l JOIN svc q ON q.username = p.username AND q.idx = p.idx - {s_a} + l.lag + {s_b}
  WHERE p.idx - {s_a} >= 0 AND p.idx - {s_a} < p.n - {max_l + 1}
),
cc_m AS (
  SELECT x.username, k.mu, k.cand, k.theta, 'A' AS kind, x.lag, -abs(k.theta) AS st,
         avg(exp(-abs(k.theta) / x.c * x.x)) AS mgf
  FROM cc_xa x JOIN {cand} k ON k.username = x.username GROUP BY x.username, k.mu, k.cand, k.theta, x.lag
  UNION ALL
  SELECT x.username, k.mu, k.cand, k.theta, 'S' AS kind, x.lag, abs(k.theta) AS st,
         avg(exp(abs(k.theta) / (k.mu * x.mean_raw) * x.x)) AS mgf
  FROM cc_xs x JOIN {cand} k ON k.username = x.username GROUP BY x.username, k.mu, k.cand, k.theta, x.lag
),
cc_b AS (
  SELECT *, coalesce(min(CASE WHEN mgf = 0 OR isinf(mgf) OR isnan(mgf) THEN lag END)
                     OVER (PARTITION BY username, mu, cand, kind), {max_l}) AS b
  FROM cc_m
),
cc AS (SELECT username, mu, cand, theta, kind, lag - 1 AS p, ln(mgf) / st AS f FROM cc_b WHERE lag < b - {cut})"""


def envelope_cte(semantics: str = "reference") -> str:
    """CTE ``env`` (username, mu, cand, s_line, a_line, sigmaa, rhoa, sigmas, rhos, theta, alpha) from ``cc``."""
    head = """
e_len AS (
  SELECT username, mu, cand, theta, count(*) FILTER (WHERE kind = 'A') AS len_a,
         count(*) FILTER (WHERE kind = 'S') AS len_s
  FROM cc GROUP BY username, mu, cand, theta
),
e_n AS (SELECT *, least(len_a, len_s) AS n, least(len_a, len_s) // 10 AS lwin FROM e_len WHERE least(len_a, len_s) >= 10),
e_sl AS (
  SELECT a.username, a.mu, a.cand, a.kind, (b.f - a.f) / n.lwin AS b
  FROM cc a JOIN e_n n ON n.username = a.username AND n.mu = a.mu AND n.cand = a.cand
  JOIN cc b ON b.username = a.username AND b.mu = a.mu AND b.cand = a.cand AND b.kind = a.kind AND b.p = a.p + n.lwin
  WHERE a.p < n.n - n.lwin
),
e_r0 AS (
  SELECT username, mu, cand, min(b) FILTER (WHERE kind = 'A') AS mina, max(b) FILTER (WHERE kind = 'A') AS maxa,
         min(b) FILTER (WHERE kind = 'S') AS mins, max(b) FILTER (WHERE kind = 'S') AS maxs
  FROM e_sl GROUP BY username, mu, cand
),
e_ok AS (
  SELECT r.username, r.mu, r.cand, n.theta, n.n,
         greatest(least(1e99, r.mina), least(1e99, r.mins)) AS min_rhoa, greatest(CAST(0 AS DOUBLE), r.maxa) AS max_rhoa,
         least(1e99, r.mins) AS min_rhos, greatest(CAST(0 AS DOUBLE), r.maxs) AS max_rhos
  FROM e_r0 r JOIN e_n n ON n.username = r.username AND n.mu = r.mu AND n.cand = r.cand
),
e_grid AS (
  SELECT o.*, g.s_line, o.min_rhos + (o.max_rhos - o.min_rhos) * (CAST(g.s_line AS DOUBLE) / CAST(10 AS DOUBLE)) AS rhos
  FROM e_ok o CROSS JOIN (SELECT CAST(range AS INTEGER) AS s_line FROM range(0, 10)) g
  WHERE NOT (o.min_rhoa > o.max_rhoa OR o.min_rhos > o.max_rhos)
),
e_a AS (SELECT CAST(range AS INTEGER) AS a_line FROM range(1, 11)),"""
    if semantics == "reference":
        body = """
e_sig AS (
  SELECT g.username, g.mu, g.cand, g.s_line, max(c.f - c.p * g.rhos) AS ms,
         max(CASE WHEN c.p < g.n THEN c.p * g.rhos - c.f END) AS sigmaa
  FROM e_grid g JOIN cc c ON c.username = g.username AND c.mu = g.mu AND c.cand = g.cand AND c.kind = 'S'
  GROUP BY g.username, g.mu, g.cand, g.s_line
),
e_env AS (
  SELECT g.username, g.mu, g.cand, g.s_line, a.a_line, s.sigmaa,
         g.min_rhoa + (g.max_rhoa - g.min_rhoa) * (CAST(a.a_line AS DOUBLE) / CAST(10 AS DOUBLE)) AS rhoa,
         s.ms - g.rhos AS sigmas, g.rhos AS rhos_used, g.min_rhos AS rhos, g.theta
  FROM e_grid g JOIN e_sig s ON s.username = g.username AND s.mu = g.mu AND s.cand = g.cand AND s.s_line = g.s_line
  CROSS JOIN e_a a
),"""
    else:
        body = """
e_sig AS (
  SELECT g.username, g.mu, g.cand, g.s_line, max(c.f - (c.p + 2) * g.rhos) AS sigmas
  FROM e_grid g JOIN cc c ON c.username = g.username AND c.mu = g.mu AND c.cand = g.cand AND c.kind = 'S'
  GROUP BY g.username, g.mu, g.cand, g.s_line
),
e_ra AS (
  SELECT g.username, g.mu, g.cand, g.s_line, a.a_line, g.rhos, g.theta, s.sigmas,
         g.min_rhoa + (g.max_rhoa - g.min_rhoa) * (CAST(a.a_line AS DOUBLE) / CAST(10 AS DOUBLE)) AS rhoa
  FROM e_grid g JOIN e_sig s ON s.username = g.username AND s.mu = g.mu AND s.cand = g.cand AND s.s_line = g.s_line
  CROSS JOIN e_a a
),
e_env AS (
  SELECT r.username, r.mu, r.cand, r.s_line, r.a_line, max((c.p + 1) * r.rhoa - c.f) AS sigmaa, r.rhoa,
         r.sigmas, r.rhos AS rhos_used, r.rhos, r.theta
  FROM e_ra r JOIN cc c ON c.username = r.username AND c.mu = r.mu AND c.cand = r.cand AND c.kind = 'A'
  GROUP BY r.username, r.mu, r.cand, r.s_line, r.a_line, r.rhoa, r.sigmas, r.rhos, r.theta
),"""
    tail = """
env AS (
  SELECT username, mu, cand, s_line, a_line, sigmaa, rhoa, sigmas, rhos, theta,
         CASE WHEN den = 0 THEN (CASE WHEN num > 0 THEN 'inf'::DOUBLE WHEN num < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END)
              ELSE num / den END AS alpha
  FROM (SELECT *, exp(theta * (sigmaa + sigmas)) AS num, 1.0 - exp(-theta * (rhoa - rhos_used)) AS den FROM e_env) z
)"""
    return head + body + tail


LN_ALPHA = "CASE WHEN alpha < 0 THEN 'nan'::DOUBLE WHEN alpha = 0 THEN '-inf'::DOUBLE ELSE ln(alpha) END"


def tau_cte() -> str:
    return f"""
taus AS (
  SELECT *,
    CASE WHEN coalesce(rhoa > rhos AND NOT isnan(rhoa) AND NOT isnan(rhos), false)
         THEN ({LN_EPS!r} - ({LN_ALPHA}) - theta * rhos) / (-theta) ELSE 0.0 END AS tau1,
    CASE WHEN coalesce(rhoa > rhos AND NOT isnan(rhoa) AND NOT isnan(rhos), false)
         THEN ({LN_EPS!r} - ({LN_ALPHA}) - {LN_K!r} - theta * rhos) / (-theta) ELSE 0.0 END AS tauk
  FROM env
)"""


def envelope_sql() -> dict[str, str]:
    fixed = f"""
fixed_cand AS (
  SELECT h.username, m.mu, 0 AS cand, CAST(0.3 AS DOUBLE) AS theta
  FROM heavy h CROSS JOIN (VALUES (CAST(1.2 AS DOUBLE)), (CAST(2.0 AS DOUBLE))) m(mu)
)"""
    grid = f"""
grid_cand AS (
  SELECT h.username, m.mu, k.cand, k.theta
  FROM heavy h CROSS JOIN (VALUES {', '.join(f'(CAST({m} AS DOUBLE))' for m in DEFAULT_MUS)}) m(mu)
  CROSS JOIN (VALUES {', '.join(f'({k}, CAST({t!r} AS DOUBLE))' for k, t in enumerate(GRID_THETAS))}) k(cand, theta)
)"""
    env_cols = f"""
SELECT username, mu, s_line, a_line, round(sigmaa, 6) AS sigmaa, round(rhoa, 6) AS rhoa,
       round(sigmas, 6) AS sigmas, round(rhos, 6) AS rhos, round({LN_ALPHA}, 6) AS ln_alpha
FROM env"""
    wa, rec = crossing_cte()
    cands = """
cand_x AS (
  SELECT f.username, f.mu, CAST(i.i * 3 + (CASE f.l WHEN 1 THEN 0 WHEN 20 THEN 1 ELSE 2 END) AS INTEGER) AS cand,
         CASE WHEN i.i = 0 THEN f.theta ELSE pow(0.98, CAST(i.i AS DOUBLE)) * f.theta END AS theta
  FROM cx_final f CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, 11)) i
)"""
    rec_sql = lambda *extra, final: with_ctes(*ANALYSIS, wa, rec, *extra, final=final).replace("WITH ", "WITH RECURSIVE ", 1)
    report = lambda semantics: rec_sql(
        cands, cand_curves_cte("cand_x", semantics), envelope_cte(semantics), tau_cte(), """
best AS (
  SELECT username, mu, min(struct_pack(tau1 := tau1, cand := cand, s_line := s_line, a_line := a_line,
                                       tauk := tauk, theta := theta)) AS b
  FROM taus
  WHERE NOT isinf(alpha) AND coalesce(tau1 > 0 AND NOT isnan(tau1), false)
  GROUP BY username, mu
)""", final="""
SELECT username, mu, round(ln(b.theta), 6) AS ln_theta, round(b.tau1, 6) AS tau1, round(b.tauk, 6) AS tauk FROM best""")

    return {
        "theta_candidates": rec_sql(cands, final="SELECT username, mu, cand, round(ln(theta), 6) AS ln_theta FROM cand_x"),
        "envelope_fit": with_ctes(*ANALYSIS, fixed, cand_curves_cte("fixed_cand"), envelope_cte(), final=env_cols),
        "envelope_fit_documented": with_ctes(*ANALYSIS, fixed, cand_curves_cte("fixed_cand", "documented"),
                                             envelope_cte("documented"), final=env_cols),
        "tau_quantiles": with_ctes(*ANALYSIS, fixed, cand_curves_cte("fixed_cand"), envelope_cte(), tau_cte(), final="""
SELECT username, mu, s_line, a_line, round(tau1, 6) AS tau1, round(tauk, 6) AS tauk FROM taus"""),
        "envelope_grid": with_ctes(*ANALYSIS, grid, cand_curves_cte("grid_cand"), envelope_cte(),
                                   final=env_cols.replace("mu, s_line", "mu, cand, s_line", 1)),
        "tau_grid": with_ctes(*ANALYSIS, grid, cand_curves_cte("grid_cand"), envelope_cte(), tau_cte(), final="""
SELECT username, mu, cand, s_line, a_line, round(tau1, 6) AS tau1, round(tauk, 6) AS tauk FROM taus"""),
        "bound_report": report("reference"),
        "files_bound_report": report("reference"),
        "bound_report_documented": report("documented"),
        "envelope_candidates": rec_sql(cands, cand_curves_cte("cand_x"), envelope_cte(), final="SELECT username, mu, cand, "
            "count(*) AS envelopes, " + ", ".join(f"round({f}({c}), 6) AS {f}_{c}" for f in ("min", "max")
                                                  for c in ("sigmaa", "rhoa", "sigmas", "rhos")) + " FROM env GROUP BY username, mu, cand"),
    }
