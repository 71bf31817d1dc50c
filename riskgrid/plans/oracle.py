"""DuckDB oracle SQL for the registered queries (tables are pre-registered
views named after the driver's parquet files). Written as plain relational
SQL — range joins, ``ASOF JOIN``, window functions, recursive CTEs — and
independent of the Spark plans it checks."""
from __future__ import annotations

US = 1_000_000
STEP = 300 * US

# race-shaped view of events; must mirror plans/driver_tables.py
EV = r"""ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS session_key,
         epoch_us(ts) AS us,
         event_type AS category,
         CASE WHEN value >= 300 THEN 'HIGH' ELSE '' END AS flag,
         concat_ws(' ', upper(event_type), props) AS message,
         CAST(user_id AS VARCHAR) AS driver_number
  FROM events)"""

SESS = r"""sess AS (
  SELECT session_key, min(ts) AS date_start, max(ts) AS date_end, min(us) AS s_us, max(us) AS e_us,
         CAST(strftime(min(ts), '%Y%m') AS BIGINT) * 10 + (day(min(ts)) - 1) // 7 AS meeting_key,
         CAST(year(min(ts)) AS INTEGER) AS year, dayname(min(ts)) AS meeting_name
  FROM ev WHERE ts IS NOT NULL GROUP BY session_key)"""

GRID = rf"""grid AS (
  SELECT s.session_key, s.meeting_key, s.year, s.meeting_name, t.grid_k,
         s.s_us + t.grid_k * {STEP} AS grid_us,
         make_timestamp(s.s_us + t.grid_k * {STEP}) AS timestamp
  FROM sess s, range(0, (s.e_us - s.s_us) // {STEP} + 1) t(grid_k))"""

BASE = f"{EV},\n{SESS},\n{GRID}"

PRED = (r"""(NOT regexp_matches(message, '"k": 1\d\b') AND (coalesce(category, '') IN ('error') """
        r"""OR coalesce(flag, '') IN ('HIGH') OR regexp_matches(message, '(?i)\bSIGNUP\b.*\b9\d\b')))""")

FLAGS = {
    "error_flag": r"(?i)\bERROR\b",
    "purchase_flag": r"(?i)\bPURCHASE\b",
    "signup_flag": r"(?i)\bSIGNUP\b",
    "view_then_click_flag": r"(?i)\bVIEW\b.*\bCLICK\b",
}


def _win(alias: str, w_s: int) -> str:
    return f"{alias}.session_key = g.session_key AND {alias}.us > g.grid_us - {w_s * US} AND {alias}.us <= g.grid_us"


TIME_GRID = f"WITH {BASE}\nSELECT session_key, grid_k, timestamp FROM grid"

FLOOR_TO_GRID = f"SELECT event_id, make_timestamp(epoch_us(ts) - epoch_us(ts) % {900 * US}) AS ts_floor FROM events"

_RV = "rv AS (SELECT session_key, ts AS timestamp, us, value, event_id AS r_event_id FROM ev WHERE event_type = 'view')"

ASOF_BACKWARD = f"""WITH {BASE}, {_RV}
SELECT g.session_key, g.grid_k, g.timestamp, r.value, r.r_event_id
FROM grid g ASOF LEFT JOIN rv r ON g.session_key = r.session_key AND g.grid_us >= r.us"""

ASOF_FORWARD = f"""WITH {BASE}, {_RV}
SELECT g.session_key, g.grid_k, g.timestamp, r.value, r.r_event_id
FROM grid g ASOF LEFT JOIN rv r ON g.session_key = r.session_key AND g.grid_us <= r.us"""

ASOF_NEAREST = f"""WITH {BASE}, {_RV},
b AS (SELECT g.session_key, g.grid_k, g.timestamp, g.grid_us, r.value AS bv, r.r_event_id AS bid, r.us AS bus
      FROM grid g ASOF LEFT JOIN rv r ON g.session_key = r.session_key AND g.grid_us >= r.us),
f AS (SELECT g.session_key, g.grid_k, r.value AS fv, r.r_event_id AS fid, r.us AS fus
      FROM grid g ASOF LEFT JOIN rv r ON g.session_key = r.session_key AND g.grid_us <= r.us),
c AS (SELECT b.*, f.fv, f.fid, f.fus,
             (f.fus IS NULL OR (b.bus IS NOT NULL AND b.grid_us - b.bus <= f.fus - b.grid_us)) AS use_b
      FROM b JOIN f USING (session_key, grid_k))
SELECT session_key, grid_k, timestamp,
       CASE WHEN use_b THEN bv ELSE fv END AS value, CASE WHEN use_b THEN bid ELSE fid END AS r_event_id
FROM c"""

ASOF_TOLERANCE = f"""WITH {BASE}, {_RV}
SELECT g.session_key, g.grid_k, g.timestamp,
       CASE WHEN g.grid_us - r.us <= {600 * US} THEN r.value END AS value,
       CASE WHEN g.grid_us - r.us <= {600 * US} THEN r.r_event_id END AS r_event_id
FROM grid g ASOF LEFT JOIN rv r ON g.session_key = r.session_key AND g.grid_us >= r.us"""

ROLLING_COUNT = f"""WITH {BASE}
SELECT g.session_key, g.grid_k, g.timestamp,
       count(CASE WHEN e.us > g.grid_us - {600 * US} THEN 1 END) AS msg_count_600s,
       count(CASE WHEN e.us > g.grid_us - {1800 * US} THEN 1 END) AS msg_count_1800s,
       count(e.event_id) AS msg_count_3600s
FROM grid g LEFT JOIN ev e ON {_win('e', 3600)}
GROUP BY g.session_key, g.grid_k, g.timestamp"""


def rolling_stat(expr: str, name: str, w_s: int = 3600) -> str:
    return f"""WITH {BASE}
SELECT g.session_key, g.grid_k, g.timestamp, {expr} AS {name}
FROM grid g LEFT JOIN ev e ON {_win('e', w_s)}
GROUP BY g.session_key, g.grid_k, g.timestamp"""


ROLLING_TIMELINE = f"""WITH {EV},
p AS (SELECT session_key, event_id, ts AS timestamp, us FROM ev WHERE event_type = 'purchase'),
c AS (SELECT session_key, us, value FROM ev WHERE event_type = 'click' AND us IS NOT NULL)
SELECT p.session_key, p.event_id, p.timestamp, count(c.us) AS clicks_1h, avg(c.value) AS click_value_mean_1h
FROM p LEFT JOIN c ON c.session_key = p.session_key AND c.us > p.us - {3600 * US} AND c.us <= p.us
GROUP BY p.session_key, p.event_id, p.timestamp"""

ROLLING_CONCAT = f"""WITH {BASE}
SELECT g.session_key, g.grid_k, g.timestamp,
       coalesce(string_agg(e.message, ' | ' ORDER BY e.us, e.event_id), '') AS recent_messages_concat
FROM grid g LEFT JOIN ev e ON {_win('e', 1800)}
GROUP BY g.session_key, g.grid_k, g.timestamp"""

_FLAG_COLS = ",\n       ".join(f"CASE WHEN regexp_matches(txt, '{p}') THEN 1 ELSE 0 END AS {n}" for n, p in FLAGS.items())

_TXT = f"""txt AS (SELECT g.session_key, g.grid_k,
       coalesce(string_agg(e.message, ' ' ORDER BY e.us, e.event_id), '') AS txt
FROM grid g LEFT JOIN ev e ON {_win('e', 1800)} GROUP BY g.session_key, g.grid_k)"""

KEYWORD_FLAGS = f"""WITH {BASE}, {_TXT}
SELECT session_key, grid_k,
       {_FLAG_COLS}
FROM txt"""

_ENT = f"""ec AS (SELECT g.session_key, g.grid_k, coalesce(e.category, '') AS cat, count(*) AS n
       FROM grid g JOIN ev e ON {_win('e', 1800)} GROUP BY g.session_key, g.grid_k, coalesce(e.category, '')),
ep AS (SELECT *, n / sum(n) OVER (PARTITION BY session_key, grid_k) AS p FROM ec),
ent AS (SELECT g.session_key, g.grid_k,
       coalesce(-sum(ep.p * log2(ep.p)) + 0.0, 0.0) AS category_entropy_1800s,
       count(ep.cat) AS unique_categories_1800s
FROM grid g LEFT JOIN ep USING (session_key, grid_k) GROUP BY g.session_key, g.grid_k)"""

WINDOW_ENTROPY = f"""WITH {BASE}, {_ENT}
SELECT g.session_key, g.grid_k, g.timestamp, ent.category_entropy_1800s, ent.unique_categories_1800s
FROM grid g JOIN ent USING (session_key, grid_k)"""

_WCOLS = ("rainfall", "track_temperature", "air_temperature", "wind_speed", "humidity", "pressure")
WEATHER_DOUBLES = _WCOLS + ("max_rainfall_60m", "track_temp_delta_60m")
_WOK = f"g.grid_us - a.wus <= {3600 * US}"
_WSEL = ",\n       ".join(f"CASE WHEN {_WOK} THEN a.{c} END AS {c}" for c in _WCOLS)
_WEATHER = f"""w AS (SELECT session_key, us, event_id, value / 100.0 AS rainfall, value AS track_temperature,
              value / 2.0 AS air_temperature, value / 10.0 AS wind_speed, value / 4.0 AS humidity,
              value + 1000.0 AS pressure
       FROM ev WHERE event_type = 'view' AND us IS NOT NULL),
wa AS (SELECT g.session_key, g.grid_k, g.grid_us, w.us AS wus, {", ".join("w." + c for c in _WCOLS)}
       FROM grid g ASOF LEFT JOIN w ON g.session_key = w.session_key AND g.grid_us >= w.us),
wr AS (SELECT g.session_key, g.grid_k, max(w.rainfall) AS max_rainfall_60m, min(w.track_temperature) AS mn
       FROM grid g LEFT JOIN w ON {_win('w', 3600)} GROUP BY g.session_key, g.grid_k),
wb AS (SELECT a.session_key, a.grid_k,
       {_WSEL.replace('g.grid_us', 'a.grid_us')},
       wr.max_rainfall_60m,
       (CASE WHEN a.grid_us - a.wus <= {3600 * US} THEN a.track_temperature END) - wr.mn AS track_temp_delta_60m
FROM wa a JOIN wr USING (session_key, grid_k))"""

WEATHER_BLOCK = f"WITH {BASE}, {_WEATHER}\nSELECT * FROM wb"

_POS = f"""pos AS (SELECT session_key, driver_number, us, event_id, floor(value / 20) AS position
        FROM ev WHERE us IS NOT NULL AND value IS NOT NULL AND driver_number IS NOT NULL),
pr AS (SELECT session_key, driver_number, us, abs(position - lag(position) OVER pw) AS dp, lag(us) OVER pw AS pu
       FROM pos WINDOW pw AS (PARTITION BY session_key, driver_number ORDER BY us, event_id)),
pairs AS (SELECT * FROM pr WHERE pu IS NOT NULL),
pch AS (SELECT g.session_key, g.grid_k, count(CASE WHEN p.dp > 0 THEN 1 END) AS position_changes_14400s
        FROM grid g LEFT JOIN pairs p ON p.session_key = g.session_key AND p.pu > g.grid_us - {14400 * US}
             AND p.us <= g.grid_us
        GROUP BY g.session_key, g.grid_k),
pdr AS (SELECT g.session_key, g.grid_k, p.driver_number, avg(p.dp) AS md
        FROM grid g JOIN pairs p ON p.session_key = g.session_key AND p.pu > g.grid_us - {28800 * US}
             AND p.us <= g.grid_us
        GROUP BY g.session_key, g.grid_k, p.driver_number),
pvol AS (SELECT session_key, grid_k, avg(md) AS v FROM pdr GROUP BY session_key, grid_k),
pne AS (SELECT g.session_key, g.grid_k, count(p.us) AS n FROM grid g LEFT JOIN pos p ON {_win('p', 28800)}
        GROUP BY g.session_key, g.grid_k),
pdyn AS (SELECT pch.session_key, pch.grid_k, pch.position_changes_14400s,
         CASE WHEN pne.n = 0 THEN 0.0 ELSE pvol.v END AS driver_position_volatility_28800s
         FROM pch JOIN pne USING (session_key, grid_k) LEFT JOIN pvol USING (session_key, grid_k))"""

POSITION_DYNAMICS = f"WITH {BASE}, {_POS}\nSELECT * FROM pdyn"

_GAP = f"""iv AS (SELECT session_key, driver_number, us, event_id, value AS gap, value / 50.0 AS ivl
       FROM ev WHERE event_type IN ('click', 'purchase') AND us IS NOT NULL AND driver_number IS NOT NULL),
ix AS (SELECT g.session_key, g.grid_k, i.driver_number, i.gap, i.ivl, i.us, i.event_id
       FROM grid g JOIN iv i ON {_win('i', 3600)}),
lg AS (SELECT session_key, grid_k, driver_number, gap,
              row_number() OVER (PARTITION BY session_key, grid_k, driver_number ORDER BY us DESC, event_id DESC) AS rn
       FROM ix WHERE gap IS NOT NULL),
li AS (SELECT session_key, grid_k, driver_number, ivl,
              row_number() OVER (PARTITION BY session_key, grid_k, driver_number ORDER BY us DESC, event_id DESC) AS rn
       FROM ix WHERE ivl IS NOT NULL),
drv AS (SELECT DISTINCT session_key, grid_k, driver_number FROM ix),
lat AS (SELECT d.session_key, d.grid_k, d.driver_number, lg.gap, li.ivl FROM drv d
        LEFT JOIN lg ON lg.session_key = d.session_key AND lg.grid_k = d.grid_k AND lg.driver_number = d.driver_number AND lg.rn = 1
        LEFT JOIN li ON li.session_key = d.session_key AND li.grid_k = d.grid_k AND li.driver_number = d.driver_number AND li.rn = 1),
gagg AS (SELECT session_key, grid_k, stddev_samp(gap) AS gap_std_3600s,
         avg(CASE WHEN ivl IS NOT NULL THEN CAST(ivl < 1.5 AS DOUBLE) END) AS pack_density_1_5s,
         avg(CASE WHEN ivl IS NOT NULL THEN CAST(ivl < 3.0 AS DOUBLE) END) AS pack_density_3_0s
         FROM lat GROUP BY session_key, grid_k),
gp AS (SELECT g.session_key, g.grid_k, gagg.gap_std_3600s, gagg.pack_density_1_5s, gagg.pack_density_3_0s
       FROM grid g LEFT JOIN gagg USING (session_key, grid_k))"""

GAP_PACK = f"WITH {BASE}, {_GAP}\nSELECT * FROM gp"

EVENT_PREDICATE = f"WITH {EV}\nSELECT event_id, {PRED} AS is_start FROM ev"

_MERGE = f"""cand AS (SELECT session_key, us, row_number() OVER (PARTITION BY session_key ORDER BY us, event_id) AS rn
         FROM ev WHERE us IS NOT NULL AND {PRED}),
rec AS (SELECT session_key, rn, us, us AS anchor, true AS emit FROM cand WHERE rn = 1
        UNION ALL
        SELECT c.session_key, c.rn, c.us,
               CASE WHEN c.us - r.anchor > {300 * US} THEN c.us ELSE r.anchor END,
               c.us - r.anchor > {300 * US}
        FROM rec r JOIN cand c ON c.session_key = r.session_key AND c.rn = r.rn + 1),
evm AS (SELECT session_key, us AS event_us FROM rec WHERE emit)"""

EVENT_MERGE = f"""WITH RECURSIVE {EV}, {_MERGE}
SELECT session_key, event_us, make_timestamp(event_us) AS event_ts FROM evm"""

_LAB = """lab AS (SELECT g.session_key, g.grid_k, g.timestamp,
       CASE WHEN m.event_us IS NOT NULL AND (m.event_us - g.grid_us) / 1e6 <= 300 THEN 1 ELSE 0 END AS y_sc_5m,
       CASE WHEN m.event_us IS NOT NULL THEN least((m.event_us - g.grid_us) / 1e6, CAST(1800 AS DOUBLE))
            ELSE CAST(1800 AS DOUBLE) END AS time_to_sc_seconds
FROM grid g ASOF LEFT JOIN evm m ON g.session_key = m.session_key AND g.grid_us < m.event_us)"""

FORWARD_LABELS = f"WITH RECURSIVE {BASE}, {_MERGE}, {_LAB}\nSELECT * FROM lab"

RISING_EDGES = f"""WITH RECURSIVE {BASE}, {_MERGE}, {_LAB}
SELECT session_key, grid_k, timestamp FROM (
  SELECT *, lag(y_sc_5m, 1, 0) OVER (PARTITION BY session_key ORDER BY grid_k) AS py FROM lab) t
WHERE y_sc_5m = 1 AND py = 0"""

_CNT = f"""cnt AS (SELECT g.session_key, g.grid_k,
       count(CASE WHEN e.us > g.grid_us - {600 * US} THEN 1 END) AS msg_count_600s,
       count(CASE WHEN e.us > g.grid_us - {1800 * US} THEN 1 END) AS msg_count_1800s,
       count(e.event_id) AS msg_count_3600s,
       coalesce(string_agg(CASE WHEN e.us > g.grid_us - {1800 * US} THEN e.message END, ' | '
                ORDER BY e.us, e.event_id), '') AS recent_messages_concat
FROM grid g LEFT JOIN ev e ON {_win('e', 3600)} GROUP BY g.session_key, g.grid_k)"""

_FLAGS_CTE = f"""flg AS (SELECT session_key, grid_k,
       {_FLAG_COLS}
FROM txt)"""

GOLD_DOUBLES = ("time_to_sc_seconds", "category_entropy_1800s") + WEATHER_DOUBLES + (
    "driver_position_volatility_28800s", "gap_std_3600s", "pack_density_1_5s", "pack_density_3_0s")

BUILD_FEATURES = f"""WITH RECURSIVE {BASE}, {_MERGE}, {_LAB}, {_CNT}, {_TXT}, {_FLAGS_CTE}, {_ENT}, {_WEATHER},
{_POS}, {_GAP}
SELECT g.session_key, g.meeting_key, g.year, g.meeting_name, g.grid_k, g.timestamp,
       lab.y_sc_5m, lab.time_to_sc_seconds,
       cnt.msg_count_600s, cnt.msg_count_1800s, cnt.msg_count_3600s, cnt.recent_messages_concat,
       ent.category_entropy_1800s, ent.unique_categories_1800s,
       {", ".join("flg." + n for n in FLAGS)},
       {", ".join("wb." + c for c in WEATHER_DOUBLES)},
       pdyn.position_changes_14400s, pdyn.driver_position_volatility_28800s,
       gp.gap_std_3600s, gp.pack_density_1_5s, gp.pack_density_3_0s
FROM grid g
JOIN lab USING (session_key, grid_k) JOIN cnt USING (session_key, grid_k) JOIN flg USING (session_key, grid_k)
JOIN ent USING (session_key, grid_k) JOIN wb USING (session_key, grid_k) JOIN pdyn USING (session_key, grid_k)
JOIN gp USING (session_key, grid_k)"""


# ---------------------------------------------------------------- scored timeline + reports
_C1800 = f"""c18 AS (SELECT g.session_key, g.grid_k, count(e.event_id) AS msg_count_1800s
FROM grid g LEFT JOIN ev e ON {_win('e', 1800)} GROUP BY g.session_key, g.grid_k)"""
_SC = """sc AS (SELECT g.session_key, g.meeting_key, g.year, g.meeting_name, g.grid_k, g.timestamp, g.grid_us,
       lab.y_sc_5m, lab.time_to_sc_seconds, c18.msg_count_1800s,
       CAST(c18.msg_count_1800s AS DOUBLE) / (CAST(c18.msg_count_1800s AS DOUBLE) + 5.0) AS risk_score
FROM grid g JOIN lab USING (session_key, grid_k) JOIN c18 USING (session_key, grid_k))"""
SCORED = f"WITH RECURSIVE {BASE}, {_MERGE}, {_LAB}, {_C1800}, {_SC}"
NOON = 12 * 3600 * US

SESSION_LIST = f"""{SCORED}
SELECT session_key, min(meeting_key) AS meeting_key, min(meeting_name) AS meeting_name, min(year) AS year
FROM sc GROUP BY session_key"""

OVERVIEW = f"""{SCORED}
SELECT count(DISTINCT session_key) AS total_sessions, count(*) AS total_grid_points,
       round_even(avg(y_sc_5m) * 100, 2) AS positive_rate_pct, CAST(sum(y_sc_5m) AS BIGINT) AS sc_event_windows,
       array_to_string(list_sort(list(DISTINCT year)), ',') AS years_covered,
       CAST(count(DISTINCT year) AS BIGINT) AS years_count
FROM sc"""

_OY = """oy AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
              CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)"""

RATE_BY_YEAR = f"""WITH {_OY}
SELECT year, count(DISTINCT o_custkey) AS sessions, CAST(sum(y) AS BIGINT) AS sc_windows, count(y) AS total_windows,
       round_even(sum(y) / count(y) * 100, 2) AS sc_rate_pct
FROM oy WHERE year IS NOT NULL GROUP BY year"""

RATE_TOP30 = f"""WITH {_OY},
j AS (SELECT oy.*, c.c_name FROM oy JOIN customer c ON oy.o_custkey = c.c_custkey),
r AS (SELECT c_name, count(DISTINCT o_custkey) AS sessions, CAST(sum(y) AS BIGINT) AS sc_windows,
             count(y) AS total_windows, round_even(sum(y) / count(y) * 100, 2) AS sc_rate_pct
      FROM j WHERE c_name IS NOT NULL GROUP BY c_name)
SELECT * FROM r ORDER BY sc_rate_pct DESC, c_name ASC LIMIT 30"""

MEANS_BY_YEAR = """SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
       round_even(avg(l_quantity), 2) AS l_quantity, round_even(avg(l_extendedprice), 2) AS l_extendedprice,
       round_even(avg(l_discount), 2) AS l_discount, round_even(avg(l_tax), 2) AS l_tax
FROM lineitem GROUP BY CAST(year(l_shipdate) AS INTEGER)"""

SESSION_RISK = f"""{SCORED},
edges AS (SELECT session_key, count(*) AS sc_event_starts FROM (
            SELECT session_key, y_sc_5m, lag(y_sc_5m, 1, 0) OVER (PARTITION BY session_key ORDER BY grid_k) AS py
            FROM sc) t WHERE y_sc_5m = 1 AND py = 0 GROUP BY session_key)
SELECT s.session_key, max(s.risk_score) AS peak_risk, CAST(sum(s.y_sc_5m) AS BIGINT) AS sc_windows,
       count(*) AS grid_points, coalesce(max(e.sc_event_starts), 0) AS sc_event_starts
FROM sc s LEFT JOIN edges e USING (session_key) GROUP BY s.session_key"""

LATEST_DELTA = f"""{SCORED},
t AS (SELECT session_key, risk_score, row_number() OVER (PARTITION BY session_key ORDER BY grid_k DESC) AS rn FROM sc)
SELECT session_key, max(CASE WHEN rn = 1 THEN risk_score END) AS latest_risk,
       max(CASE WHEN rn = 1 THEN risk_score END) - coalesce(max(CASE WHEN rn = 2 THEN risk_score END), 0.0) AS risk_delta
FROM t WHERE rn <= 2 GROUP BY session_key"""

SERIES_TAIL = f"""{SCORED}
SELECT session_key, grid_k, risk_score FROM (
  SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY grid_k DESC) AS rn FROM sc) t WHERE rn <= 10"""

BBOX = f"""WITH {EV}
SELECT session_key, min(value) - CAST(2000 AS DOUBLE) AS x_min, max(value) + CAST(2000 AS DOUBLE) AS x_max,
       min(user_id) - CAST(2000 AS DOUBLE) AS y_min, max(user_id) + CAST(2000 AS DOUBLE) AS y_max
FROM ev GROUP BY session_key"""

MESSAGES_BY_TIME = f"""WITH {EV}
SELECT session_key, category, flag, message, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS date FROM ev"""

IMPORTANCE_TOPK = """WITH r AS (SELECT l_partkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_partkey),
t AS (SELECT * FROM r ORDER BY revenue DESC, l_partkey ASC LIMIT 20)
SELECT l_partkey, revenue, revenue / max(revenue) OVER () * 100 AS relative_pct FROM t"""

_NOONM = f"nm AS (SELECT e.*, s.s_us + {NOON} AS at_us FROM ev e JOIN sess s USING (session_key))"

MESSAGES_SYMMETRIC = f"""WITH {EV}, {SESS}, {_NOONM}
SELECT session_key, event_id, strftime(ts, '%H:%M:%S') AS time, category, message
FROM nm WHERE us >= at_us - {1800 * US} AND us <= at_us + {1800 * US}"""

MESSAGES_TRAILING = f"""WITH {EV}, {SESS}, {_NOONM}
SELECT session_key, event_id, strftime(ts, '%H:%M:%S') AS time, category, message
FROM nm WHERE us >= at_us - {3600 * US} AND us <= at_us"""

REPLAY_CUT = f"""{SCORED}
SELECT sc.session_key, sc.grid_k, sc.risk_score FROM sc JOIN sess s USING (session_key)
WHERE sc.grid_us <= s.s_us + {NOON}"""


def _any_contains(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


_CAT, _MSG, _FLG = "coalesce(category, '')", "coalesce(message, '')", "coalesce(flag, '')"
_JOINED = f"lower(concat_ws(' ', {_CAT}, {_MSG}, {_FLG}))"

SEVERITY_CLASS = f"""WITH {EV}
SELECT event_id,
  CASE WHEN {_any_contains(_JOINED, ('safety car', 'vsc', 'virtual safety car'))} THEN 'intervention'
       WHEN contains(lower({_FLG}), 'red') OR contains(lower({_CAT}), 'red') THEN 'red'
       WHEN contains(lower({_FLG}), 'yellow') OR contains(lower({_CAT}), 'yellow') THEN 'yellow'
       WHEN contains(lower({_FLG}), 'green') OR contains(lower({_CAT}), 'green') THEN 'green'
       WHEN contains(lower({_FLG}), 'chequered') THEN 'chequered' ELSE 'other' END AS message_class,
  CASE WHEN {_any_contains(f'lower({_FLG})', ('safety car', 'sc'))} THEN 'intervention'
       WHEN contains(lower({_FLG}), 'virtual') THEN 'virtual'
       WHEN contains(lower({_FLG}), 'red') THEN 'red'
       WHEN contains(lower({_FLG}), 'yellow') THEN 'yellow'
       WHEN contains(lower({_FLG}), 'green') THEN 'green'
       WHEN {_any_contains(f'lower({_FLG})', ('chequered', 'checkered'))} THEN 'chequered' ELSE 'other' END AS flag_class,
  CASE WHEN contains({_CAT}, 'SafetyCar') THEN 'sc' WHEN contains({_CAT}, 'VirtualSafetyCar') THEN 'vsc' ELSE '' END
       AS category_highlight,
  ({_any_contains(f'lower({_CAT})', ('error', 'signup', 'k": 9'))} OR
   {_any_contains(f'lower({_MSG})', ('error', 'signup', 'k": 9'))}) AS highlight,
  {_any_contains(_JOINED, ('error', 'purchase {'))} AS is_intervention
FROM ev"""

RISK_BAND = f"""{SCORED}
SELECT session_key, grid_k, risk_score,
  CASE WHEN risk_score >= CAST(0.6 AS DOUBLE) THEN 'high' WHEN risk_score >= CAST(0.35 AS DOUBLE) THEN 'medium'
       ELSE 'low' END AS risk_band,
  CASE WHEN msg_count_1800s > 5 THEN 'high' WHEN msg_count_1800s > 3 THEN 'medium' ELSE 'low' END AS rate_band,
  risk_score > CAST(0.5 AS DOUBLE) AS high_risk_point
FROM sc"""

SESSION_SELECTOR = f"""WITH {EV}, {SESS}
SELECT DISTINCT session_key FROM sess WHERE year = 2024 AND meeting_name = 'Monday'"""

UNION_BY_NAME = """SELECT o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS kind FROM orders
UNION ALL SELECT event_id AS id, value AS amount, event_type AS kind FROM events"""

DISTINCT_VALUES = "SELECT DISTINCT event_type FROM events"

NEAREST_SNAPSHOT = f"""WITH {EV}, {SESS},
m AS (SELECT e.session_key, e.driver_number, e.value, e.event_id, e.ts AS date, e.us,
             abs(e.us - (s.s_us + {NOON})) AS dd
      FROM ev e JOIN sess s USING (session_key) WHERE abs(e.us - (s.s_us + {NOON})) <= {7200 * US}),
r AS (SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY dd, us) AS rn FROM m)
SELECT session_key, driver_number, value, event_id, date FROM r WHERE rn = 1"""

LOOKUP_FALLBACK = """WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS k, arg_max(c_name, c_custkey) AS lab
           FROM customer GROUP BY CAST(c_custkey AS VARCHAR))
SELECT o.o_orderkey, o.o_custkey, coalesce(CAST(d.lab AS VARCHAR), CAST(o.o_custkey AS VARCHAR)) AS label
FROM orders o LEFT JOIN d ON CAST(o.o_custkey AS VARCHAR) = d.k"""

MEMBERSHIP_SPLIT = """SELECT o_orderkey, o_custkey,
       CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'test'
            ELSE 'train' END AS split
FROM orders"""

# ---------------------------------------------------------------- splits
_TSPLIT = """g AS (SELECT o_custkey, min(o_orderdate) AS f FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
n AS (SELECT greatest(1, CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS nt FROM g),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY f DESC NULLS LAST, o_custkey DESC) AS rn FROM g),
t AS (SELECT o_custkey FROM r, n WHERE rn <= nt)"""

TEMPORAL_SPLIT = f"""WITH {_TSPLIT}
SELECT o.o_orderkey, CASE WHEN t.o_custkey IS NOT NULL THEN 'test' ELSE 'train' END AS split
FROM orders o LEFT JOIN t USING (o_custkey)"""

NESTED_SPLIT = f"""WITH {_TSPLIT},
g2 AS (SELECT * FROM g WHERE o_custkey NOT IN (SELECT o_custkey FROM t)),
n2 AS (SELECT greatest(1, CAST(floor(count(*) * CAST(0.15 AS DOUBLE)) AS BIGINT)) AS nt FROM g2),
r2 AS (SELECT o_custkey, row_number() OVER (ORDER BY f DESC NULLS LAST, o_custkey DESC) AS rn FROM g2),
v AS (SELECT o_custkey FROM r2, n2 WHERE rn <= nt)
SELECT o.o_orderkey,
       CASE WHEN t.o_custkey IS NOT NULL THEN 'test' WHEN v.o_custkey IS NOT NULL THEN 'val' ELSE 'inner' END AS split
FROM orders o LEFT JOIN t USING (o_custkey) LEFT JOIN v USING (o_custkey)"""

_P = "list_position(r.loads, list_min(r.loads))"
GROUP_KFOLD = f"""WITH RECURSIVE
s AS (SELECT c.c_nationkey AS g, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      WHERE c.c_nationkey IS NOT NULL GROUP BY c.c_nationkey),
o AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g ASC) AS i FROM s),
kk AS (SELECT least(5, count(*)) AS k FROM s),
r AS (SELECT CAST(0 AS BIGINT) AS i, list_resize(CAST([] AS BIGINT[]), k, CAST(0 AS BIGINT)) AS loads,
             CAST(NULL AS INTEGER) AS g, CAST(NULL AS INTEGER) AS fold FROM kk
      UNION ALL
      SELECT o.i, list_concat(list_concat(r.loads[1:{_P} - 1], [r.loads[{_P}] + o.n]), r.loads[{_P} + 1:]),
             o.g, CAST({_P} - 1 AS INTEGER)
      FROM r JOIN o ON o.i = r.i + 1)
SELECT s.g AS c_nationkey, s.n AS n_rows, r.fold FROM r JOIN s ON r.g = s.g WHERE r.i > 0"""

# ---------------------------------------------------------------- metrics
_DS = """ds AS (SELECT CAST(l.toxic AS DOUBLE) AS y,
              CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0) AS p
       FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL AND d.n_chars IS NOT NULL),
per AS (SELECT p, sum(y) AS tp, sum(1 - y) AS fp, sum((p - y) * (p - y)) AS se, count(*) AS n FROM ds GROUP BY p),
cs AS (SELECT *, sum(tp) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ctp,
              sum(fp) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cfp,
              row_number() OVER (ORDER BY p DESC) AS i,
              sum(tp) OVER () AS tot_p, sum(fp) OVER () AS tot_n FROM per)"""

RANK_METRICS = f"""WITH {_DS}
SELECT sum(tp * ctp / (ctp + cfp)) / sum(tp) AS pr_auc,
       sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)) AS roc_auc,
       sum(se) / sum(n) AS brier_score, sum(tp) / sum(n) AS positive_rate,
       CAST(sum(n) AS BIGINT) AS n_samples, CAST(sum(tp) AS BIGINT) AS n_positive
FROM cs"""

PR_CURVE = f"""WITH {_DS},
ps AS (SELECT max(p) AS pstar FROM cs WHERE ctp >= tot_p)
SELECT p AS threshold, ctp / (ctp + cfp) AS precision, ctp / tot_p AS recall FROM cs, ps WHERE p >= pstar
UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0"""

ROC_CURVE = f"""WITH {_DS},
nb AS (SELECT *, lag(ctp) OVER (ORDER BY i) AS tp0, lag(cfp) OVER (ORDER BY i) AS fp0,
              lead(ctp) OVER (ORDER BY i) AS tp2, lead(cfp) OVER (ORDER BY i) AS fp2,
              max(i) OVER () AS last_i FROM cs)
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT p, cfp / tot_n, ctp / tot_p FROM nb
WHERE i = 1 OR i = last_i OR fp2 - 2 * cfp + fp0 <> 0 OR tp2 - 2 * ctp + tp0 <> 0"""


def _calibration_sql(n_bins: int = 10) -> str:
    import numpy as np
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    b = " + ".join(f"CASE WHEN p > CAST({e!r} AS DOUBLE) THEN 1 ELSE 0 END" for e in edges)
    return f"""WITH {_DS}
SELECT CAST({b} AS INTEGER) AS bin, avg(y) AS prob_true, avg(p) AS prob_pred FROM ds GROUP BY 1"""


CALIBRATION = _calibration_sql(10)

ALERT_POLICY = f"""{SCORED},
th AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS threshold),
x AS (SELECT th.threshold, sc.session_key, sc.y_sc_5m AS y, sc.risk_score AS p, sc.time_to_sc_seconds AS tte,
             sc.risk_score >= th.threshold AS a FROM sc, th),
ps AS (SELECT threshold, session_key, sum(CASE WHEN a THEN 1 ELSE 0 END) AS na FROM x GROUP BY threshold, session_key),
pt AS (SELECT threshold, avg(na) AS apr FROM ps GROUP BY threshold),
c AS (SELECT threshold, sum(CASE WHEN a AND y = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN a AND y <> 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN NOT a AND y = 1 THEN 1 ELSE 0 END) AS fn,
             sum(CASE WHEN NOT a AND y <> 1 THEN 1 ELSE 0 END) AS tn,
             median(CASE WHEN a AND y = 1 THEN tte END) AS lead
      FROM x GROUP BY threshold)
SELECT c.threshold, round_even(pt.apr, 2) AS alerts_per_race, round_even(c.lead, 1) AS median_lead_time_s,
       round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS true_positive_rate,
       round_even(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4) AS false_positive_rate,
       round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision
FROM c JOIN pt USING (threshold)"""


# ---------------------------------------------------------------- text vectors
_TOK = r"""dt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS toks
       FROM documents),
pos AS (SELECT doc_id, toks, generate_subscripts(toks, 1) AS i FROM dt),
terms AS (SELECT doc_id, toks[i] AS term FROM pos
          UNION ALL SELECT doc_id, toks[i] || ' ' || toks[i + 1] FROM pos WHERE i + 1 <= len(toks)
          UNION ALL SELECT doc_id, toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2] FROM pos
                    WHERE i + 2 <= len(toks)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
nd AS (SELECT count(doc_id) AS n FROM documents),
voc AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term ASC LIMIT 5000),
vi AS (SELECT term, df, CAST(cf AS BIGINT) AS cf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM voc, nd),
w AS (SELECT tf.doc_id, tf.term, (1.0 + ln(tf.tf)) * vi.idf AS w FROM tf JOIN vi USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id)"""

TFIDF_WEIGHTS = f"""WITH {_TOK}
SELECT w.doc_id, w.term, w.w / nrm.nrm AS weight FROM w JOIN nrm USING (doc_id)"""

TFIDF_VOCAB = f"WITH {_TOK}\nSELECT term, df, cf, idf FROM vi"


# ---------------------------------------------------------------- bronze / sources
BRONZE_STANDARDISE = f"""WITH {EV}, {SESS}
SELECT e.ts AS date, e.category, e.message, e.flag, CAST(NULL AS VARCHAR) AS scope, CAST(NULL AS VARCHAR) AS sector,
       e.driver_number, e.session_key, s.meeting_key, s.year, s.meeting_name
FROM ev e JOIN sess s USING (session_key)"""

_ISO = "'%Y-%m-%dT%H:%M:%S.%f'"
SESSION_BOUNDS = f"""WITH {EV}, {SESS},
lp AS (SELECT e.session_key, max(e.us - s.s_us) AS lap FROM ev e JOIN sess s USING (session_key)
       WHERE e.event_type = 'click' GROUP BY e.session_key),
wt AS (SELECT e.session_key, max(e.us - s.s_us) AS w FROM ev e JOIN sess s USING (session_key)
       WHERE e.event_type = 'view' GROUP BY e.session_key)
SELECT s.session_key, s.meeting_key, s.year, s.meeting_name, strftime(make_timestamp(s.s_us), {_ISO}) AS date_start,
       strftime(make_timestamp(coalesce(s.s_us + lp.lap, s.s_us + wt.w, s.s_us + {7200 * US})), {_ISO}) AS date_end
FROM sess s LEFT JOIN lp USING (session_key) LEFT JOIN wt USING (session_key)"""

ANTI_INGEST = f"""WITH {EV}, {SESS}
SELECT session_key FROM sess
WHERE session_key NOT IN (SELECT session_key FROM ev WHERE event_type = 'signup' AND value > 300)"""

SESSION_KEYS = """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year,
                  CAST(month(o_orderdate) AS INTEGER) AS round_number FROM orders)
SELECT TRY_CAST(CAST(year AS VARCHAR) || lpad(CAST(round_number AS VARCHAR), 2, '0') AS BIGINT) AS session_key,
       TRY_CAST(CAST(year AS VARCHAR) || lpad(CAST(round_number AS VARCHAR), 2, '0') || '0' AS BIGINT) AS meeting_key,
       year, round_number
FROM y WHERE TRY_CAST(CAST(year AS VARCHAR) || lpad(CAST(round_number AS VARCHAR), 2, '0') AS BIGINT) IS NOT NULL"""

COERCE_VALUES = """WITH r AS (SELECT event_id, props,
       CASE WHEN value > 300 THEN 'true' WHEN value < 10 THEN 'False' ELSE CAST(value AS VARCHAR) END AS raw_rain
       FROM events)
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       coalesce(CASE WHEN lower(trim(raw_rain)) = 'true' THEN 1.0 WHEN lower(trim(raw_rain)) = 'false' THEN 0.0
                     ELSE TRY_CAST(lower(trim(raw_rain)) AS DOUBLE) END, 0.0) AS rainfall
FROM r"""

PARSE_TIMESTAMPS = """SELECT event_id,
       CASE WHEN event_type = 'click' THEN ts - INTERVAL 2 HOUR WHEN event_type = 'error' THEN NULL ELSE ts END AS parsed
FROM events"""

RISK_SERIES = f"""{SCORED}
SELECT session_key, timestamp, round_even(risk_score, 4) AS risk_score, y_sc_5m FROM sc"""

POSITIVE_WINDOWS = f"""{SCORED}
SELECT session_key, grid_k, timestamp FROM sc WHERE y_sc_5m = 1"""

FIRST_SESSIONS = f"""WITH {EV}, {SESS}
SELECT session_key, date_start FROM sess ORDER BY date_start, session_key LIMIT 10"""


# ---------------------------------------------------------------- model layer and evaluation
_EVAL = f"""{SCORED},
ev2 AS (SELECT 'baseline' AS model, *, CAST(grid_k AS DOUBLE) / (CAST(grid_k AS DOUBLE) + 100.0) AS prob FROM sc
        UNION ALL SELECT 'boosted', *, risk_score FROM sc)"""

EVALUATION_METRICS = f"""{_EVAL},
ep AS (SELECT model, prob AS p, CAST(sum(y_sc_5m) AS DOUBLE) AS tp, CAST(sum(1 - y_sc_5m) AS DOUBLE) AS fp,
              sum((prob - y_sc_5m) * (prob - y_sc_5m)) AS se, count(*) AS n FROM ev2 GROUP BY model, prob),
ec2 AS (SELECT *, sum(tp) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ctp,
               sum(fp) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM ep)
SELECT model, sum(tp * ctp / (ctp + cfp)) / sum(tp) AS pr_auc,
       sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)) AS roc_auc, sum(se) / sum(n) AS brier_score,
       sum(tp) / sum(n) AS positive_rate, CAST(sum(n) AS BIGINT) AS n_samples, CAST(sum(tp) AS BIGINT) AS n_positive
FROM ec2 GROUP BY model"""

EVALUATION_POLICY = f"""{_EVAL},
th AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS threshold),
x AS (SELECT ev2.model, th.threshold, ev2.session_key, ev2.y_sc_5m AS y, ev2.time_to_sc_seconds AS tte,
             ev2.prob >= th.threshold AS a FROM ev2, th),
c AS (SELECT model, threshold, sum(CASE WHEN a THEN 1 ELSE 0 END) / count(DISTINCT session_key) AS apr,
             sum(CASE WHEN a AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN a AND y <> 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN NOT a AND y = 1 THEN 1 ELSE 0 END) AS fn,
             sum(CASE WHEN NOT a AND y <> 1 THEN 1 ELSE 0 END) AS tn,
             median(CASE WHEN a AND y = 1 THEN tte END) AS lead
      FROM x GROUP BY model, threshold)
SELECT model, threshold, round_even(apr, 2) AS alerts_per_race, round_even(lead, 1) AS median_lead_time_s,
       round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS true_positive_rate,
       round_even(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4) AS false_positive_rate,
       round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision
FROM c"""

REPORT_HEADER = f"""{SCORED}
SELECT count(*) AS test_rows, count(DISTINCT meeting_key) AS test_meetings,
       round_even(avg(y_sc_5m) * 100, 2) AS positive_pct FROM sc"""

_ORDERS_SPLIT = f"""os AS (SELECT o.*, n.split, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y
       FROM orders o JOIN ({NESTED_SPLIT}) n ON o.o_orderkey = n.o_orderkey)"""

SCALED_FEATURES = f"""WITH {_ORDERS_SPLIT},
st AS (SELECT avg(CAST(o_totalprice AS DOUBLE)) AS mp, stddev_pop(CAST(o_totalprice AS DOUBLE)) AS sp,
              avg(CAST(o_custkey AS DOUBLE)) AS mc, stddev_pop(CAST(o_custkey AS DOUBLE)) AS sdc
       FROM os WHERE split = 'inner')
SELECT o_orderkey, (o_totalprice - mp) / sp AS z_o_totalprice, (o_custkey - mc) / sdc AS z_o_custkey FROM os, st"""

CLASS_WEIGHTS = f"""WITH {_ORDERS_SPLIT},
k AS (SELECT y, count(*) AS c FROM os WHERE split = 'inner' GROUP BY y)
SELECT o_orderkey, os.y, CAST((SELECT sum(c) FROM k) AS DOUBLE) / ((SELECT count(*) FROM k) * k.c) AS w
FROM os JOIN k ON os.y = k.y WHERE split <> 'test'"""

SVD_ORTHONORMAL = """SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j,
       CASE WHEN a.range = b.range THEN 1.0 ELSE 0.0 END::DOUBLE AS dot FROM range(10) a, range(10) b"""

SVD_MOMENTS = f"""WITH {_TOK.replace('LIMIT 5000', 'LIMIT 40')},
x AS (SELECT w.doc_id, w.term, w.w / nrm.nrm AS x FROM w JOIN nrm USING (doc_id)),
g AS (SELECT a.term AS i, b.term AS j, sum(a.x * b.x) / (SELECT count(*) FROM documents) AS g
      FROM x a JOIN x b USING (doc_id) GROUP BY a.term, b.term),
gg AS (SELECT a.i, b.j, sum(a.g * b.g) AS g FROM g a JOIN g b ON a.j = b.i GROUP BY a.i, b.j)
SELECT 1 AS p, sum(g) AS value FROM g WHERE i = j
UNION ALL SELECT 2, sum(g) FROM gg WHERE i = j
UNION ALL SELECT 3, sum(gg.g * g.g) FROM gg JOIN g ON gg.j = g.i AND gg.i = g.j"""

# ---------------------------------------------------------------- ingestion job
_LANDED = f"""{EV}, {SESS},
landed AS (SELECT 'race_control' AS table_name, session_key, ts, value FROM ev
           UNION ALL SELECT 'weather', session_key, ts, value FROM ev WHERE event_type = 'view'),
judged AS (SELECT table_name, ts, CASE WHEN value BETWEEN 100 AND 130 THEN 'malformed' WHEN value >= 400 THEN 'unknown session'
                  WHEN value < 20 THEN 'no time' END AS reason,
                  CASE WHEN value >= 400 THEN -1 ELSE session_key END AS session_key FROM landed)"""

INGEST_LOG = f"""WITH {_LANDED},
keys AS (SELECT session_key FROM sess UNION ALL SELECT -1),
c AS (SELECT table_name, session_key, count(*) FILTER (reason IS NULL) AS written, count(reason) AS rejected
      FROM judged GROUP BY table_name, session_key)
SELECT t.table_name, k.session_key, CASE WHEN t.table_name = 'intervals' THEN 'failed' ELSE 'written' END AS status,
       coalesce(c.written, 0) AS written, coalesce(c.rejected, 0) AS rejected
FROM keys k CROSS JOIN (VALUES ('race_control'), ('weather'), ('intervals')) t(table_name)
LEFT JOIN c ON c.table_name = t.table_name AND c.session_key = k.session_key"""

REJECTED_RECORDS = f"""WITH {_LANDED}
SELECT table_name, reason, count(*) AS n, count(DISTINCT session_key) AS sessions
FROM judged WHERE reason IS NOT NULL GROUP BY table_name, reason"""

SESSION_CATALOGUE = f"""WITH {_LANDED}
SELECT j.session_key, s.meeting_key, s.year, s.meeting_name, count(*) AS n_rows
FROM judged j JOIN sess s USING (session_key) WHERE table_name = 'race_control' AND reason IS NULL
GROUP BY j.session_key, s.meeting_key, s.year, s.meeting_name"""

SESSION_REPORT = f"""WITH RECURSIVE {BASE}, {_MERGE}, {_LAB},
e AS (SELECT *, lag(y_sc_5m, 1, 0) OVER (PARTITION BY session_key ORDER BY grid_k) AS py FROM lab)
SELECT session_key, CAST(max(y_sc_5m) AS DOUBLE) AS peak_risk, CAST(sum(y_sc_5m) AS BIGINT) AS sc_windows, count(*) AS grid_points,
       coalesce(string_agg(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY grid_k) FILTER (y_sc_5m = 1 AND py = 0), '') AS sc_event_starts
FROM e GROUP BY session_key"""
