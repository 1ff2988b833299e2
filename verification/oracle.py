"""SQL equivalents of the registered queries, for an independent engine on the same parquet tables.

Each statement is assembled from the named steps it needs. The SQL knows nothing of the way the
Spark side cuts, orders or materialises its work.
"""

from __future__ import annotations

import re

import numpy as np

SCALE = 10_000
FINE_SCALE = 10_000_000
FINE = ("cpf_fuel_rate_lps", "vsp_value", "vsp_co2_rate", "vsp_nox_rate", "E_cpf_fuel", "E_vsp_NOx", "E_fuel", "E_real_fuel", "E_base_fuel")


def _fit_weights(window: int, place: int, derivative: int) -> list[float]:
    """Weights of a cubic fit, found by fitting each unit impulse."""
    positions = np.arange(window) - place
    row = []
    for j in range(window):
        impulse = np.zeros(window)
        impulse[j] = 1.0
        polynomial = np.polyfit(positions, impulse, 3)
        row.append(float(polynomial[3 - derivative]))
    return row


def _weights(derivative: int) -> str:
    rows = [_fit_weights(w, place, derivative) for w in (9, 7, 5) for place in range(w)]
    return "[" + ",".join("[" + ",".join(f"{x:.17g}::DOUBLE" for x in row) + "]" for row in rows) + "]"


def _r(expression: str, name: str | None = None) -> str:
    scale = FINE_SCALE if (name or expression) in FINE else SCALE
    return f"floor(CAST({expression} AS DOUBLE) * {scale} + 0.5::DOUBLE) / {scale}::DOUBLE AS {name or expression}"


def _rs(*names: str) -> str:
    return ", ".join(_r(n) for n in names)


def _ints(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


K = _ints("recordingId", "trackId", "frame")

STEPS = {
    "bound": "SELECT max(user_id) AS mx FROM events",
    "base": """
        SELECT user_id % 4 + 1 + 4 * (user_id // 128) AS recordingId, user_id + 1 AS trackId,
          CASE WHEN user_id % 2 = 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS rate,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
          count(*) OVER (PARTITION BY user_id) AS n_rows,
          CASE WHEN user_id % 3 = 0 THEN 25 + value / (abs(value) + 50) ELSE 20 + 30 * value / (abs(value) + 100) END AS spd,
          CASE WHEN user_id % 5 = 0 THEN 12.0::DOUBLE ELSE 4.5::DOUBLE END AS width, 2.0::DOUBLE AS height,
          CASE WHEN user_id % 5 = 0 THEN 2 ELSE 1 END AS veh_class,
          1 + (user_id // 4) % 2 AS dir,
          CASE WHEN user_id % 3 = 0 OR user_id + 8 > mx OR (user_id + 8) // 128 > user_id // 128 THEN 0 ELSE user_id + 9 END AS precedingId,
          (1000 + 25 * (user_id // 8) + (event_id * 7) % 11)::DOUBLE AS place,
          CASE WHEN user_id % 3 <> 0 AND event_type = 'signup' THEN 3 ELSE 2 END AS lane
        FROM events, bound""",
    "tracks": """
        SELECT *, CASE WHEN dir = 2 THEN place - width / 2 ELSE 3000 - place - width / 2 END AS x,
          (2.0 + 4 * lane)::DOUBLE AS y, CASE WHEN dir = 2 THEN spd ELSE -spd END AS xv
        FROM base""",
    "extent": """
        SELECT recordingId, any_value(rate) AS rate, min(x) AS min_x, max(x + width) AS max_x, min(y) AS min_y, max(y + height) AS max_y
        FROM tracks GROUP BY recordingId""",
    "uni": """
        SELECT t.*, e.min_x, e.max_x, e.min_y, e.max_y, t.frame / t.rate AS time,
          CASE WHEN dir = 2 THEN x + width / 2 ELSE max_x - (x + width / 2) END AS s_long,
          y + height / 2 AS d_lat, CASE WHEN dir = 2 THEN xv ELSE -xv END AS v_raw
        FROM tracks t JOIN extent e USING (recordingId)""",
    "near": """
        SELECT *, frame - 1 AS p, CASE WHEN n_rows >= 9 THEN 9 WHEN n_rows >= 7 THEN 7 WHEN n_rows >= 5 THEN 5 END AS w,
          list(v_raw) OVER (PARTITION BY recordingId, trackId ORDER BY frame
                            ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS vals,
          lag(lane) OVER (PARTITION BY recordingId, trackId ORDER BY frame) AS lane_before
        FROM uni""",
    "placed": """
        SELECT *, greatest(0, least(p - w // 2, n_rows - w)) AS st,
          CASE w WHEN 9 THEN 0 WHEN 7 THEN 9 ELSE 16 END AS row0 FROM near""",
    "sg": f"""
        SELECT *,
          CAST(CASE WHEN w IS NULL THEN v_raw ELSE list_dot_product(
            vals[st - greatest(0, p - 8) + 1 : st - greatest(0, p - 8) + w], {_weights(0)}[row0 + p - st + 1]) END AS FLOAT) AS vs,
          CAST(CASE WHEN w IS NULL THEN v_raw ELSE list_dot_product(
            vals[st - greatest(0, p - 8) + 1 : st - greatest(0, p - 8) + w], {_weights(1)}[row0 + p - st + 1]) END AS FLOAT) AS acc
        FROM placed""",
    "led": """
        SELECT f.*, l.s_long AS leader_s_long, l.vs AS leader_v_long, l.acc AS leader_a_long,
          l.s_long - f.s_long - 0.5 * (l.width + f.width) AS gap, f.vs - l.vs AS rel
        FROM sg f LEFT JOIN sg l
          ON l.recordingId = f.recordingId AND l.frame = f.frame AND l.trackId = f.precedingId""",
    "safe": """
        SELECT *, CAST(CASE WHEN vs = 0 THEN 99 ELSE gap / vs END AS FLOAT) AS time_headway,
          CAST(coalesce(CASE WHEN -rel > 0 THEN gap / (-rel) END, 99) AS FLOAT) AS ttc,
          CAST(CASE WHEN gap - CASE WHEN rel > 0 THEN rel ELSE 0 END > 0
            THEN CASE WHEN rel > 0 THEN rel * rel ELSE 0 END / (2 * (gap - CASE WHEN rel > 0 THEN rel ELSE 0 END))
            END AS FLOAT) AS drac
        FROM led""",
    "power": """
        SELECT *, CASE WHEN ttc < 2 THEN 2 WHEN ttc < 4 THEN 1 ELSE 0 END AS risk,
          CASE veh_class WHEN 2 THEN 'HDDT' ELSE 'LDV' END AS cat,
          CASE veh_class
            WHEN 2 THEN (7239.0::DOUBLE * (1 + 0.10::DOUBLE) * acc::DOUBLE
              + 7239.0::DOUBLE * 9.80665::DOUBLE * 1.75::DOUBLE / 1000.0::DOUBLE * (0.0328::DOUBLE * (vs::DOUBLE * 3.6::DOUBLE) + 4.575::DOUBLE)
              + 0.5::DOUBLE * 1.2256::DOUBLE * 8.90::DOUBLE * 0.78::DOUBLE * (vs::DOUBLE * vs::DOUBLE)) * vs::DOUBLE / (1000.0::DOUBLE * 0.95::DOUBLE)
            ELSE (1453.0::DOUBLE * (1 + 0.04::DOUBLE) * acc::DOUBLE
              + 1453.0::DOUBLE * 9.80665::DOUBLE * 1.75::DOUBLE / 1000.0::DOUBLE * (0.0328::DOUBLE * (vs::DOUBLE * 3.6::DOUBLE) + 4.575::DOUBLE)
              + 0.5::DOUBLE * 1.2256::DOUBLE * 2.32::DOUBLE * 0.30::DOUBLE * (vs::DOUBLE * vs::DOUBLE)) * vs::DOUBLE / (1000.0::DOUBLE * 0.92::DOUBLE)
          END AS kw
        FROM safe""",
    "fuelled": """
        SELECT *, CASE WHEN kw >= 0 THEN 4.7738e-4::DOUBLE + 5.363e-5::DOUBLE * kw + 1.0e-6::DOUBLE * (kw * kw)
                  ELSE 4.7738e-4::DOUBLE END AS lps,
          CAST((vs::DOUBLE * acc::DOUBLE + 0.00035::DOUBLE * (vs::DOUBLE * vs::DOUBLE * vs::DOUBLE) + 0.132::DOUBLE * vs::DOUBLE
            + 0.000302::DOUBLE * (vs::DOUBLE * vs::DOUBLE)) / 1500.0::DOUBLE AS FLOAT) AS vsp
        FROM power""",
    "frames": """
        SELECT *, CAST(lps AS FLOAT) AS fuel, CAST(lps * CASE veh_class WHEN 2 THEN 2680.0 ELSE 2310.0 END AS FLOAT) AS co2,
          CAST(CASE WHEN vsp < 0 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE * vsp + 0.5::DOUBLE END AS FLOAT) AS vco2,
          CAST(CASE WHEN vsp < 0 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE * vsp + 0.05::DOUBLE END AS FLOAT) AS vnox,
          CAST((x - min_x) / greatest(max_x - min_x, 1e-6) * 1280 AS FLOAT) AS x_img,
          CAST((y - min_y) / greatest(max_y - min_y, 1e-6) * 720 AS FLOAT) AS y_img
        FROM fuelled""",
    # Conflict runs for the three thresholds of the sweep; 4.0 is the detection threshold.
    "levels": "SELECT unnest([2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE]) AS thr",
    "island_rows": """
        SELECT thr, recordingId, trackId, frame, ttc, rate,
          frame - row_number() OVER (PARTITION BY thr, recordingId, trackId ORDER BY frame) AS island
        FROM frames JOIN levels ON ttc < thr""",
    "islands": """
        SELECT thr, recordingId, trackId, min(frame) AS run_start, max(frame) AS run_end, count(*) AS run_rows,
          round(count(*) * (1 / any_value(rate)), 9) AS conf_duration, min(ttc)::DOUBLE AS min_TTC_conf
        FROM island_rows GROUP BY thr, recordingId, trackId, island""",
    "cores": """
        SELECT i.*, greatest(1, run_start - 3) AS start_frame, least(n_rows, run_end + 5) AS end_frame
        FROM islands i JOIN (SELECT DISTINCT recordingId, trackId, n_rows FROM base) USING (recordingId, trackId)""",
    "conf_all": """
        SELECT c.thr, c.recordingId, c.trackId AS ego_id, c.start_frame, c.end_frame, c.run_start AS conf_start_frame,
          c.run_end AS conf_end_frame, c.conf_duration, c.min_TTC_conf, min(f.time) AS start_time, max(f.time) AS end_time,
          round(count(*) * (1 / any_value(f.rate)), 9) AS duration, min(f.ttc)::DOUBLE AS min_TTC, min(f.veh_class) AS veh_class,
          count(*) FILTER (WHERE f.frame > c.start_frame AND f.lane <> f.lane_before) AS num_lane_changes,
          sum(f.co2::DOUBLE * (1 / f.rate)) AS E_cpf_CO2, sum(f.fuel::DOUBLE * (1 / f.rate)) AS E_cpf_fuel,
          sum(f.vco2::DOUBLE * (1 / f.rate)) AS E_vsp_CO2, sum(f.vnox::DOUBLE * (1 / f.rate)) AS E_vsp_NOx
        FROM cores c JOIN frames f ON f.recordingId = c.recordingId AND f.trackId = c.trackId
          AND f.frame BETWEEN c.start_frame AND c.end_frame
        GROUP BY ALL""",
    "conf": """
        SELECT row_number() OVER (PARTITION BY recordingId ORDER BY ego_id, conf_start_frame) AS event_id, * EXCLUDE (thr)
        FROM conf_all WHERE thr = 4.0 AND conf_duration >= 0.4""",
    "starts": "SELECT recordingId, trackId, unnest(range(1, n_rows - 6, 4)) AS start_frame FROM (SELECT DISTINCT recordingId, trackId, n_rows FROM base)",
    "base_all": """
        SELECT s.recordingId, s.trackId AS ego_id, s.start_frame, s.start_frame + 7 AS end_frame, min(f.time) AS start_time,
          max(f.time) AS end_time, round(count(*) * (1 / any_value(f.rate)), 9) AS duration, min(f.veh_class) AS veh_class,
          min(f.ttc)::DOUBLE AS min_TTC, avg(f.ttc::DOUBLE) AS mean_TTC,
          count(*) FILTER (WHERE f.frame > s.start_frame AND f.lane <> f.lane_before) AS num_lane_changes,
          sum(f.co2::DOUBLE * (1 / f.rate)) AS E_cpf_CO2, sum(f.fuel::DOUBLE * (1 / f.rate)) AS E_cpf_fuel,
          sum(f.vco2::DOUBLE * (1 / f.rate)) AS E_vsp_CO2, sum(f.vnox::DOUBLE * (1 / f.rate)) AS E_vsp_NOx
        FROM starts s JOIN frames f ON f.recordingId = s.recordingId AND f.trackId = s.trackId
          AND f.frame BETWEEN s.start_frame AND s.start_frame + 7
        GROUP BY s.recordingId, s.trackId, s.start_frame
        HAVING min(f.ttc) > 4 AND max(abs(f.acc)) < 0.5 AND count(DISTINCT f.lane) <= 1""",
    "calm": "SELECT row_number() OVER (PARTITION BY recordingId ORDER BY ego_id, start_frame) AS event_id, * FROM base_all",
    "all_events": """
        SELECT 'conflict' AS kind, recordingId, event_id, ego_id, start_frame, end_frame, duration FROM conf
        UNION ALL
        SELECT 'baseline', recordingId, event_id, ego_id, start_frame, end_frame, duration FROM calm""",
    "metrics": """
        SELECT b.kind, b.recordingId, b.event_id, sum(f.co2::DOUBLE * (1 / f.rate)) AS E_CO2,
          sum(f.fuel::DOUBLE * (1 / f.rate)) AS E_fuel,
          CASE WHEN count(*) > 1 THEN max_by(f.s_long, f.frame) - min_by(f.s_long, f.frame) END AS dist_m,
          any_value(b.duration) AS duration, avg(f.vs::DOUBLE) AS mean_v
        FROM all_events b JOIN frames f ON f.recordingId = b.recordingId AND f.trackId = b.ego_id
          AND f.frame BETWEEN b.start_frame AND b.end_frame
        GROUP BY b.kind, b.recordingId, b.event_id""",
    "conf_m": """
        SELECT c.*, m.E_CO2, m.E_fuel, m.dist_m, m.mean_v FROM conf c
        LEFT JOIN metrics m ON m.kind = 'conflict' AND m.recordingId = c.recordingId AND m.event_id = c.event_id""",
    "calm_m": """
        SELECT c.*, m.E_CO2, m.E_fuel, m.dist_m, m.mean_v FROM calm c
        LEFT JOIN metrics m ON m.kind = 'baseline' AND m.recordingId = c.recordingId AND m.event_id = c.event_id""",
    "ranked": """
        SELECT c.recordingId, c.event_id, b.event_id AS base_id,
          row_number() OVER (PARTITION BY c.recordingId, c.event_id ORDER BY
            pow((c.duration - b.duration) / 2.0, 2) + pow((c.mean_v - b.mean_v) / 5.0, 2), b.event_id) AS place
        FROM conf_m c JOIN calm_m b ON b.recordingId = c.recordingId AND b.veh_class = c.veh_class
          AND abs(b.duration - c.duration) <= 2.0""",
    "matched": """
        SELECT c.recordingId AS rec_id, c.event_id - 1 AS event_id, c.event_id AS l2_event_id, c.ego_id, c.veh_class,
          'unknown' AS flow_state, c.min_TTC_conf, c.conf_duration, c.duration, b.duration AS duration_base,
          c.dist_m AS dist_real_m, b.dist_m AS dist_base_m, c.E_CO2 AS E_real_CO2, c.E_fuel AS E_real_fuel,
          b.E_CO2 AS E_base_CO2, b.E_fuel AS E_base_fuel, c.mean_v AS mean_v_conf, b.mean_v AS mean_v_base,
          CASE WHEN c.dist_m > 1e-6 THEN c.E_CO2 / (c.dist_m / 1000) END AS E_real_CO2_per_km,
          CASE WHEN b.dist_m > 1e-6 THEN b.E_CO2 / (b.dist_m / 1000) END AS E_base_CO2_per_km,
          CASE WHEN c.duration > 0 THEN c.E_CO2 / c.duration END AS E_real_CO2_per_s,
          CASE WHEN b.duration > 0 THEN b.E_CO2 / b.duration END AS E_base_CO2_per_s,
          c.E_CO2 - b.E_CO2 AS MEC_CO2_per_event,
          CASE WHEN c.min_TTC_conf IS NULL THEN 'unknown' WHEN c.min_TTC_conf < 2 THEN '<2' WHEN c.min_TTC_conf < 3 THEN '2-3'
               WHEN c.min_TTC_conf < 4 THEN '3-4' ELSE '>=4' END AS MEC_bucket,
          b.event_id AS base_event_id, b.ego_id AS base_ego_id, b.start_frame AS base_start_frame,
          b.end_frame AS base_end_frame, b.mean_TTC AS base_mean_TTC
        FROM conf_m c LEFT JOIN ranked r ON r.recordingId = c.recordingId AND r.event_id = c.event_id AND r.place = 1
        LEFT JOIN calm_m b ON b.recordingId = c.recordingId AND b.event_id = r.base_id""",
    "milder": """
        SELECT c.recordingId AS rec_id, c.event_id - 1 AS event_id, c.event_id AS l2_event_id, b.event_id AS base_event_id, c.duration,
          b.duration AS duration_base, c.mean_v AS mean_v_conf, b.mean_v AS mean_v_base, c.E_CO2 - b.E_CO2 AS MEC_CO2_per_event,
          row_number() OVER (PARTITION BY c.recordingId, c.event_id ORDER BY
            pow((c.duration - b.duration) / 2.0, 2) + pow((c.mean_v - b.mean_v) / 5.0, 2), b.event_id) AS place
        FROM conf_m c LEFT JOIN conf_m b ON b.recordingId = c.recordingId AND b.veh_class = c.veh_class
          AND abs(b.duration - c.duration) <= 2.0 AND b.min_TTC_conf >= 2.0
        WHERE c.min_TTC_conf < 2.0""",
    "mec": "SELECT *, E_real_CO2_per_km - E_base_CO2_per_km AS MEC_CO2_per_km FROM matched",
    "binned": """
        SELECT *, CASE veh_class WHEN 1 THEN 'Car' WHEN 2 THEN 'Truck' END AS vclass,
          CASE WHEN min_TTC_conf IS NULL OR min_TTC_conf < 0 THEN 'unknown' WHEN min_TTC_conf <= 2 THEN '<=2s'
               WHEN min_TTC_conf <= 3 THEN '(2,3]s' WHEN min_TTC_conf <= 4 THEN '(3,4]s' ELSE '>4s' END AS severity_bin,
          CASE WHEN conf_duration IS NULL OR conf_duration < 0 THEN 'unknown' WHEN conf_duration <= 0.4 THEN '<=0.4s'
               WHEN conf_duration <= 0.6 THEN '(0.4,0.6]s' WHEN conf_duration <= 0.8 THEN '(0.6,0.8]s'
               WHEN conf_duration <= 1.0 THEN '(0.8,1.0]s' ELSE '>1.0s' END AS duration_bin
        FROM mec""",
    "l2p": """
        SELECT coalesce(c.recordingId, b.recordingId) AS rec_id, coalesce(n_conf, 0) AS n_conf, coalesce(n_base, 0) AS n_base,
          median_conf_duration, median_min_TTC_conf, median_E_cpf_CO2_conf
        FROM (SELECT recordingId, count(*) AS n_conf, quantile_cont(conf_duration, 0.5) AS median_conf_duration,
                quantile_cont(min_TTC_conf, 0.5) AS median_min_TTC_conf, quantile_cont(E_cpf_CO2, 0.5) AS median_E_cpf_CO2_conf
              FROM conf GROUP BY recordingId) c
        FULL JOIN (SELECT recordingId, count(*) AS n_base FROM calm GROUP BY recordingId) b ON b.recordingId = c.recordingId""",
    "fields": """
        SELECT 'conflict' AS event_type, unnest(['conf_duration', 'min_TTC_conf', 'duration', 'E_cpf_CO2', 'E_cpf_fuel', 'E_cpf_CO2_per_s']) AS field,
          unnest([conf_duration, min_TTC_conf, duration, E_cpf_CO2, E_cpf_fuel, E_cpf_CO2 / nullif(duration, 0)]) AS val FROM conf
        UNION ALL
        SELECT 'baseline', unnest(['min_TTC', 'duration', 'E_cpf_CO2', 'E_cpf_fuel']),
          unnest([min_TTC, duration, E_cpf_CO2, E_cpf_fuel]) FROM calm""",
    "anchors": """
        SELECT c.recordingId, c.event_id, c.ego_id, c.start_frame, c.end_frame, arg_min(f.frame, f.ttc * 1e9 + f.frame) AS f0
        FROM conf c JOIN frames f ON f.recordingId = c.recordingId AND f.trackId = c.ego_id
          AND f.frame BETWEEN c.start_frame AND c.end_frame
        GROUP BY ALL""",
    "near_rows": """
        SELECT a.recordingId, a.event_id, f.frame - a.f0 AS "offset", f.ttc::DOUBLE AS ttc, f.co2::DOUBLE AS co2
        FROM anchors a JOIN frames f ON f.recordingId = a.recordingId AND f.trackId = a.ego_id
          AND f.frame BETWEEN a.start_frame AND a.end_frame AND f.frame - a.f0 BETWEEN -5 AND 10""",
    "series": """
        SELECT g.recordingId, g.event_id, g."offset", r.ttc, r.co2
        FROM (SELECT recordingId, event_id, unnest(range(-5, 11)) AS "offset" FROM conf) g
        LEFT JOIN near_rows r ON r.recordingId = g.recordingId AND r.event_id = g.event_id AND r."offset" = g."offset" """,
    "lags": """
        SELECT recordingId, event_id, arg_min("offset", -co2 * 1e6 + "offset") / 1.0 AS lag
        FROM near_rows WHERE co2 IS NOT NULL GROUP BY recordingId, event_id""",
    "phase": """
        SELECT c.recordingId, c.event_id, f.frame, least(greatest(f.ttc::DOUBLE, 0), 60) AS TTC, f.co2::DOUBLE AS energy
        FROM conf c JOIN frames f ON f.recordingId = c.recordingId AND f.trackId = c.ego_id
          AND f.frame BETWEEN c.start_frame AND c.end_frame""",
    "severe": """
        SELECT * FROM conf WHERE min_TTC_conf < 2 AND conf_duration >= 0.8
        ORDER BY recordingId, min_TTC_conf, event_id LIMIT 5""",
    "box": """
        SELECT x0 - 1e-9 * (x1 - x0) AS x0, (x1 + 1e-9 * (x1 - x0) - (x0 - 1e-9 * (x1 - x0))) / 60 AS sx, y0, (y1 - y0) / 34 AS sy
        FROM (SELECT min(TTC) AS x0, max(TTC) AS x1, min(energy) AS y0, max(energy) AS y1 FROM phase)""",
    "hexed": """
        SELECT (TTC - x0) / sx AS u, (energy - y0) / sy AS v, x0, sx, y0, sy FROM phase, box""",
    "hexes": """
        SELECT *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2)
               < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS near FROM hexed""",
    "steps": """
        SELECT recordingId, trackId, s_long - lag(s_long) OVER (PARTITION BY recordingId, trackId ORDER BY frame) AS step
        FROM frames""",
}


def _needs(sql: str) -> list[str]:
    """Steps a statement uses, directly or through others, in order of definition."""
    wanted: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name in STEPS:
            if name not in wanted and re.search(rf"(?i)\b(FROM|JOIN|,)\s+\(?\s*{name}\b", text):
                wanted.add(name)
                pending.append(STEPS[name])
    return [name for name in STEPS if name in wanted]


def _statement(sql: str) -> str:
    steps = ", ".join(f"{name} AS ({STEPS[name].strip()})" for name in _needs(sql))
    return f"WITH {steps} {sql.strip()}"


def _q(column: str, q: float, name: str) -> str:
    return _r(f"quantile_cont(CAST({column} AS DOUBLE), {q})", name)


def _field_rows(template: str, fields: dict[str, str]) -> str:
    return " UNION ALL ".join(template.format(name=n, column=c) for n, c in fields.items())


_NULL_FIELDS = {
    "recordingId": "recordingId", "frame": "frame", "trackId": "trackId", "s_long": "s_long", "v_long_smooth": "vs",
    "veh_class": "veh_class", "drivingDirection": "dir", "TTC": "ttc", "DRAC": "coalesce(drac, 1)", "risk_level": "risk",
    "cpf_co2_rate_gps": "co2", "cpf_fuel_rate_lps": "fuel", "vsp_co2_rate": "vco2", "vsp_nox_rate": "vnox",
}
_EMISSIONS = {"cpf_co2_rate_gps": "co2", "cpf_fuel_rate_lps": "fuel", "vsp_co2_rate": "vco2", "vsp_nox_rate": "vnox"}
_CONF_REAL = ("start_time", "end_time", "duration", "conf_duration", "min_TTC", "min_TTC_conf",
              "E_cpf_CO2", "E_cpf_fuel", "E_vsp_CO2", "E_vsp_NOx")
_BASE_REAL = ("start_time", "end_time", "duration", "min_TTC", "mean_TTC", "E_cpf_CO2", "E_cpf_fuel", "E_vsp_CO2", "E_vsp_NOx")
_MEC_REAL = ("min_TTC_conf", "conf_duration", "duration", "duration_base", "dist_real_m", "dist_base_m", "E_real_CO2",
             "E_real_fuel", "E_base_CO2", "E_base_fuel", "mean_v_conf", "mean_v_base", "E_real_CO2_per_km",
             "E_base_CO2_per_km", "E_real_CO2_per_s", "E_base_CO2_per_s", "MEC_CO2_per_km", "MEC_CO2_per_event",
             "base_mean_TTC")
_M = "MEC_CO2_per_km"
_LEADER_COLUMNS = f"""{_r('leader_s_long')}, {_r('leader_v_long')}, {_r('leader_a_long')}, {_r('gap', 'dist_headway')},
    {_r('rel', 'rel_velocity')}, {_r('time_headway')}"""
_FUEL_COLUMNS = f"""cat AS vehicle_type, {_r('CAST(vs::DOUBLE * 3.6::DOUBLE AS FLOAT)', 'v_kmh')},
    {_r('CAST(acc::DOUBLE * 3.6::DOUBLE AS FLOAT)', 'a_kmhps')}, {_r('CAST(kw AS FLOAT)', 'cpf_power_kw')},
    {_r('fuel', 'cpf_fuel_rate_lps')}, {_r('co2', 'cpf_co2_rate_gps')}"""
_VSP_COLUMNS = f"{_r('vsp', 'vsp_value')}, {_r('vco2', 'vsp_co2_rate')}, {_r('vnox', 'vsp_nox_rate')}"
_ZERO = lambda *names: ", ".join(f"CAST(0 AS BIGINT) AS {n}" for n in names)

_QUERIES = {
    "l1_keys_and_meta": f"""SELECT {K}, CAST(recordingId * 10000 + trackId AS BIGINT) AS global_track_id, {_r('time')},
        {_ints('veh_class')}, {_rs('width', 'height')}, CAST(lane AS BIGINT) AS laneId_raw, {_r('CAST(1 / rate AS FLOAT)', 'dt')}, {_ints('n_rows')} FROM uni""",
    "l1_recording_extents": f"SELECT {_ints('recordingId')}, {_rs('min_x', 'max_x', 'min_y', 'max_y')}, {_r('rate', 'frameRate')} FROM extent",
    "l1_unify_coordinates": f"""SELECT {K}, CAST(dir AS BIGINT) AS drivingDirection, {_rs('s_long', 'd_lat')},
        {_r('v_raw', 'v_long_raw')}, {_r('0.0', 'a_long_raw')} FROM uni""",
    "l1_minmax_scale": f"SELECT {K}, {_rs('x_img', 'y_img')} FROM frames",
    "l1_savgol": f"SELECT {K}, {_r('vs', 'v_long_smooth')}, {_r('acc', 'a_long_smooth')} FROM sg",
    "l1_leader_join": f"SELECT {K}, {_LEADER_COLUMNS} FROM safe",
    "l1_ttc_drac_risk": f"SELECT {K}, {_r('ttc', 'TTC')}, {_r('drac', 'DRAC')}, CAST(risk AS BIGINT) AS risk_level FROM power",
    "l1_cpfm": f"SELECT {K}, {_FUEL_COLUMNS} FROM frames",
    "l1_vsp": f"SELECT {K}, {_VSP_COLUMNS} FROM frames",
    "l1_master": f"""SELECT {K}, CAST(recordingId * 10000 + trackId AS BIGINT) AS global_track_id, {_r('time')}, {_r('x', 'x_raw')},
        {_r('y', 'y_raw')}, {_rs('width', 'height')}, CAST(lane AS BIGINT) AS laneId_raw, {_rs('x_img', 'y_img')},
        CAST(dir AS BIGINT) AS drivingDirection, {_ints('veh_class')}, {_rs('s_long', 'd_lat')}, {_r('v_raw', 'v_long_raw')},
        {_r('0.0', 'a_long_raw')}, {_r('vs', 'v_long_smooth')}, {_r('acc', 'a_long_smooth')}, {_ints('precedingId')},
        {_ZERO('followingId', 'leftPrecedingId', 'leftAlongsideId', 'leftFollowingId', 'rightPrecedingId',
               'rightAlongsideId', 'rightFollowingId')}, {_LEADER_COLUMNS}, {_r('0.0', 'dist_headway_raw')},
        {_r('0.0', 'time_headway_raw')}, {_r('0.0', 'ttc_raw')}, {_r('ttc', 'TTC')}, {_r('drac', 'DRAC')},
        CAST(risk AS BIGINT) AS risk_level, {_FUEL_COLUMNS}, {_VSP_COLUMNS}, {_r('CAST(1 / rate AS FLOAT)', 'dt')} FROM frames""",
    "l2_islands": f"""SELECT {_ints('recordingId', 'trackId', 'run_start', 'run_end', 'run_rows')},
        {_rs('conf_duration', 'min_TTC_conf')} FROM islands WHERE thr = 4.0""",
    "l2_conflict_events": f"""SELECT {_ints('event_id', 'recordingId', 'ego_id', 'start_frame', 'end_frame', 'conf_start_frame',
        'conf_end_frame', 'veh_class', 'num_lane_changes')}, {_rs(*_CONF_REAL)} FROM conf""",
    "l2_baseline_events": f"""SELECT {_ints('event_id', 'recordingId', 'ego_id', 'start_frame', 'end_frame', 'veh_class',
        'num_lane_changes')}, {_rs(*_BASE_REAL)} FROM calm""",
    "episode_metrics": f"SELECT kind, {_ints('recordingId', 'event_id')}, {_rs('E_CO2', 'E_fuel', 'dist_m', 'duration', 'mean_v')} FROM metrics",
    "episode_kinematics": f"""SELECT {_ints('recordingId', 'event_id')}, {_rs('max_decel', 'max_accel', 'v_drop')} FROM (
        SELECT c.recordingId, c.event_id, min(f.acc)::DOUBLE AS max_decel, max(f.acc)::DOUBLE AS max_accel,
          max(f.vs)::DOUBLE - min(f.vs)::DOUBLE AS v_drop
        FROM conf c JOIN frames f ON f.recordingId = c.recordingId AND f.trackId = c.ego_id
          AND f.frame BETWEEN c.start_frame AND c.end_frame GROUP BY c.recordingId, c.event_id)""",
    "mec_match": f"""SELECT {_ints('rec_id', 'event_id', 'l2_event_id', 'ego_id', 'veh_class', 'base_event_id', 'base_ego_id',
        'base_start_frame', 'base_end_frame')}, flow_state, MEC_bucket, {_rs(*_MEC_REAL)} FROM mec""",
    "mec_match_varied": f"""SELECT {_ints('rec_id', 'event_id', 'l2_event_id', 'base_event_id')},
        {_rs('duration', 'duration_base', 'mean_v_conf', 'mean_v_base', 'MEC_CO2_per_event')} FROM milder WHERE place = 1""",
    "mec_headline": f"SELECT count(*) AS n_events, {_q(_M, 0.5, 'median')}, {_q(_M, 0.1, 'p10')}, {_q(_M, 0.9, 'p90')} FROM mec",
    "mec_bucket_median": f"SELECT MEC_bucket, count(*) AS n_events, {_q(_M, 0.5, 'median_MEC_CO2_per_km')} FROM mec GROUP BY MEC_bucket",
    "mec_debug_summary": f"""SELECT count(*) AS n_events, {_r(f'avg({_M})', 'mec_per_km_mean')}, {_q(_M, 0.5, 'mec_per_km_median')},
        {_r(f'min({_M})', 'mec_per_km_min')}, {_r(f'max({_M})', 'mec_per_km_max')},
        {_r('avg(MEC_CO2_per_event)', 'mec_per_event_mean')}, {_q('MEC_CO2_per_event', 0.5, 'mec_per_event_median')},
        NULL::VARCHAR AS min_TTC_bucket, NULL::DOUBLE AS median_MEC_CO2_per_km FROM mec
        UNION ALL
        SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, MEC_bucket, {_q(_M, 0.5, 'm')} FROM mec GROUP BY MEC_bucket""",
    "mec_basic_stats": f"""SELECT 'overall' AS scope, NULL::VARCHAR AS severity_bin, NULL::VARCHAR AS veh_class, count({_M}) AS count,
        {_r(f'avg({_M})', 'mean')}, {_q(_M, 0.5, 'median')}, {_r(f'min({_M})', 'min')}, {_r(f'max({_M})', 'max')},
        {_q(_M, 0.1, 'q10')}, {_q(_M, 0.9, 'q90')} FROM binned
        UNION ALL
        SELECT 'by_group', severity_bin, vclass, NULL, NULL, {_q(_M, 0.5, 'median')}, NULL, NULL, {_q(_M, 0.1, 'q10')},
        {_q(_M, 0.9, 'q90')} FROM binned GROUP BY severity_bin, vclass""",
    "mec_summary": f"""SELECT severity_bin, flow_state, count(event_id) AS n_events, {_r('avg(duration)', 'mean_duration_real')},
        {_r('avg(E_real_CO2_per_km)', 'mean_E_real_CO2_per_km')}, {_r('avg(E_base_CO2_per_km)', 'mean_E_base_CO2_per_km')},
        {_r(f'avg({_M})', 'mean_MEC_CO2_per_km')}, {_r(f'avg({_M}) / avg(E_real_CO2_per_km) * 100', 'MEC_share_pct')}
        FROM binned GROUP BY severity_bin, flow_state""",
    "severity_duration_bins": "SELECT severity_bin, duration_bin, count(*) AS n_events FROM binned GROUP BY severity_bin, duration_bin",
    "threshold_sweep": f"""SELECT {_rs('TTC_thr', 'dur_thr')}, count(c.thr) AS n_conf, {_q('min_TTC_conf', 0.5, 'med_min_TTC_conf')},
        {_q('conf_duration', 0.5, 'med_conf_dur')}, {_q('E_cpf_CO2', 0.5, 'med_E_CO2')}
        FROM (SELECT thr AS TTC_thr, unnest([0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS dur_thr FROM levels) g
        LEFT JOIN conf_all c ON c.thr = g.TTC_thr AND c.conf_duration >= g.dur_thr GROUP BY TTC_thr, dur_thr""",
    "l1_profile": f"""SELECT CAST(recordingId AS BIGINT) AS rec_id, count(*) AS n_rows, CAST(50 AS BIGINT) AS n_cols,
        {_r('count(ttc) / count(*)', 'ttc_notnull_ratio')}, {_r('count(co2) / count(*)', 'co2_notnull_ratio')},
        {_r('count(fuel) / count(*)', 'fuel_notnull_ratio')} FROM frames GROUP BY recordingId""",
    "l1_overall": f"""SELECT count(*) AS n_recordings, CAST(sum(n) AS BIGINT) AS total_frames, {_r('avg(n)', 'mean_frames')}
        FROM (SELECT recordingId, count(*) AS n FROM frames GROUP BY recordingId)""",
    "l2_profile": f"SELECT {_ints('rec_id', 'n_conf', 'n_base')}, {_rs('median_conf_duration', 'median_min_TTC_conf', 'median_E_cpf_CO2_conf')} FROM l2p",
    "l2_overall": f"""SELECT CAST(sum(n_conf) AS BIGINT) AS total_conf, CAST(sum(n_base) AS BIGINT) AS total_base,
        {_q('median_conf_duration', 0.5, 'median_conf_duration')}, {_q('median_min_TTC_conf', 0.5, 'median_min_TTC_conf')},
        {_q('median_E_cpf_CO2_conf', 0.5, 'median_E_cpf_CO2_conf')} FROM l2p""",
    "l2_recording_summary": f"""SELECT CAST(coalesce(c.recordingId, b.recordingId) AS BIGINT) AS recording, coalesce(n, 0) AS conflict_events,
        coalesce(m, 0) AS baseline_events, {_rs('min_TTC_conf_median', 'min_TTC_conf_sum', 'conf_duration_median', 'conf_duration_sum',
        'E_cpf_CO2_median', 'E_cpf_CO2_sum')}
        FROM (SELECT recordingId, count(*) AS n, quantile_cont(min_TTC_conf, 0.5) AS min_TTC_conf_median, sum(min_TTC_conf) AS min_TTC_conf_sum,
                quantile_cont(conf_duration, 0.5) AS conf_duration_median, sum(conf_duration) AS conf_duration_sum,
                quantile_cont(E_cpf_CO2, 0.5) AS E_cpf_CO2_median, sum(E_cpf_CO2) AS E_cpf_CO2_sum FROM conf GROUP BY recordingId) c
        FULL JOIN (SELECT recordingId, count(*) AS m FROM calm GROUP BY recordingId) b ON b.recordingId = c.recordingId""",
    "l2_describe": f"""SELECT event_type, field, count(val) AS count, {_r('avg(val)', 'mean')}, {_r('stddev_samp(val)', 'std')},
        {_r('min(val)', 'min')}, {_r('max(val)', 'max')}, {_q('val', 0.25, 'q25')}, {_q('val', 0.5, 'q50')}, {_q('val', 0.75, 'q75')}
        FROM fields GROUP BY event_type, field""",
    "l2_value_counts": """SELECT event_type, CAST(veh_class AS BIGINT) AS veh_class, count(*) AS count FROM (
        SELECT 'conflict' AS event_type, veh_class FROM conf UNION ALL SELECT 'baseline', veh_class FROM calm)
        GROUP BY event_type, veh_class""",
    "dq_null_ratio": _field_rows(
        "SELECT '{name}' AS field, " + _r("avg(CASE WHEN {column} IS NULL THEN 1.0 ELSE 0.0 END)", "null_ratio") + " FROM frames",
        _NULL_FIELDS),
    "dq_numeric_summary": _field_rows(
        "SELECT '{name}' AS field, " + ", ".join(_r(f"{fn}({{column}}::DOUBLE)", nm) for fn, nm in (("min", "min"), ("avg", "mean"), ("max", "max")))
        + " FROM frames", {"v_long_smooth": "vs", "a_long_smooth": "acc"}),
    "dq_monotonic": f"""SELECT {_ints('recordingId', 'trackId')}, count(*) FILTER (WHERE step < 0) AS negative_count, count(step) AS total_steps,
        {_r('coalesce(count(*) FILTER (WHERE step < 0) / nullif(count(step), 0), 0)', 'negative_ratio')} FROM steps GROUP BY recordingId, trackId""",
    "dq_emissions": _field_rows(
        "SELECT '{name}' AS field, " + ", ".join(_r(f"{fn}({{column}}::DOUBLE)", nm) for fn, nm in (("min", "min"), ("avg", "mean"), ("max", "max")))
        + ", " + _r("avg(CASE WHEN {column} < 0 THEN 1.0 ELSE 0.0 END)", "neg_ratio")
        + ", max({column}) > 1e6 AS exceeds_max, avg(CASE WHEN {column} < 0 THEN 1.0 ELSE 0.0 END) <= 1e-3 AS neg_ratio_ok FROM frames",
        _EMISSIONS),
    "dq_headway": f"SELECT {_r('avg(CASE WHEN 0.0 > 0 THEN 1.0 ELSE 0.0 END)', 'pos_ratio')}, {_r('avg(abs(gap - 0.0))', 'mean_abs_diff')} FROM frames WHERE precedingId > 0",
    "dq_ttc_quantiles": f"SELECT {_q('ttc', 0.05, 'q_low')}, {_q('ttc', 0.95, 'q_high')} FROM frames WHERE precedingId > 0 AND rel > 0 AND gap > 0",
    "dq_ttc_quantiles_closing": f"""SELECT {_q('ttc', 0.05, 'q_low')}, {_q('ttc', 0.95, 'q_high')} FROM (
        SELECT CAST(gap / rel AS FLOAT) AS ttc FROM frames WHERE precedingId > 0 AND rel > 0 AND gap > 0)""",
    "dq_track_quality": f"""SELECT count(*) AS n_rows, {_r('avg(CASE WHEN vs < 0 THEN 1.0 ELSE 0.0 END)', 'v_negative_ratio')}, {_r('max(vs::DOUBLE)', 'v_max')},
        {_r('avg(CASE WHEN abs(acc) <= 10 THEN 1.0 ELSE 0.0 END)', 'a_inside_ratio')},
        {_r('avg(CASE WHEN co2 >= 0 THEN 1.0 ELSE 0.0 END)', 'co2_nonneg_ratio')},
        {_r('avg(CASE WHEN fuel >= 0 THEN 1.0 ELSE 0.0 END)', 'fuel_nonneg_ratio')},
        {_r('max(co2::DOUBLE)', 'co2_max')}, {_r('max(fuel::DOUBLE)', 'fuel_max')} FROM frames""",
    "dq_raw_alignment": f"""SELECT {K}, {_r('0.0', 'x_diff')}, {_r('0.0', 'y_diff')}, {_r('abs(CASE WHEN dir = 2 THEN xv ELSE -xv END - v_raw)', 'v_long_diff')} FROM uni""",
    "dq_row_drift": f"SELECT {_ints('recordingId')}, count(*) AS raw_rows, count(*) AS l1_rows, {_r('0.0', 'diff_ratio')} FROM uni GROUP BY recordingId",
    "recording_selection": f"""SELECT {_ints('recordingId')}, count(*) AS n_rows, 'recording_0' || recordingId AS name FROM base
        WHERE recordingId IN (1, 2, 4) GROUP BY recordingId""",
    "head_sample": f"""SELECT {K}, {_r('s_long')}, {_r('vs', 'v_long_smooth')} FROM frames
        QUALIFY row_number() OVER (PARTITION BY recordingId ORDER BY trackId, frame) <= 5""",
    "sample_tracks": f"""SELECT {_ints('recordingId', 'trackId')} FROM (SELECT DISTINCT recordingId, trackId FROM base)
        ORDER BY md5(concat_ws('|', recordingId, trackId, 42)) LIMIT 5""",
    "sample_events": f"""SELECT {_ints('recordingId', 'event_id', 'ego_id', 'start_frame', 'end_frame')} FROM conf
        ORDER BY md5(concat_ws('|', recordingId, event_id, 0)) LIMIT 10""",
    "frame_snapshot": f"SELECT {K}, {_rs('x_img', 'y_img')}, {_r('ttc', 'colour')} FROM frames WHERE frame = 25",
    "track_profile": f"SELECT {_ints('frame')}, {_r('s_long')}, {_r('vs', 'v_long_smooth')} FROM frames WHERE recordingId = 2 AND trackId = 2",
    "event_trace": f"""SELECT CAST(c.recordingId AS BIGINT) AS recordingId, CAST(c.event_id AS BIGINT) AS event_id, CAST(f.frame AS BIGINT) AS frame,
        {_r('f.time - c.start_time', 't')}, {_r('f.vs', 'v_long_smooth')}, {_r('f.acc', 'a_long_smooth')}, {_r('f.co2', 'cpf_co2_rate_gps')},
        f.frame BETWEEN c.conf_start_frame AND c.conf_end_frame AS in_core
        FROM conf c JOIN frames f ON f.recordingId = c.recordingId AND f.trackId = c.ego_id AND f.frame BETWEEN c.start_frame AND c.end_frame""",
    "aligned_series": f"""SELECT {_ints('recordingId', 'event_id')}, CAST("offset" AS BIGINT) AS "offset", {_rs('ttc', 'co2')} FROM series""",
    "aligned_curve": f"""SELECT CAST("offset" AS BIGINT) AS "offset", {_r('"offset" / 1.0', 't')}, {_r('avg(ttc)', 'TTC_mean')}, {_r('avg(co2)', 'CO2_mean')},
        count(*) AS n_episodes, {_q('ttc', 0.1, 'TTC_p10')}, {_q('ttc', 0.9, 'TTC_p90')}, {_q('co2', 0.1, 'CO2_p10')}, {_q('co2', 0.9, 'CO2_p90')}
        FROM series GROUP BY "offset" """,
    "episode_lags": f"SELECT {_ints('recordingId', 'event_id')}, {_r('lag')} FROM lags",
    "lag_stats": f"SELECT {_r('avg(lag)', 'mean')}, {_q('lag', 0.5, 'median')}, {_q('lag', 0.1, 'p10')}, {_q('lag', 0.9, 'p90')} FROM lags",
    "phase_plane_samples": f"SELECT {_ints('recordingId', 'event_id', 'frame')}, {_rs('TTC', 'energy')} FROM phase",
    "phase_plane_hexbin": f"""SELECT {_r('cu * sx + x0', 'centre_x')}, {_r('cv * sy + y0', 'centre_y')}, count(*) AS n FROM (
        SELECT CASE WHEN near THEN round_even(u, 0) ELSE floor(u) + 0.5 END AS cu,
          CASE WHEN near THEN round_even(v, 0) ELSE floor(v) + 0.5 END AS cv, x0, sx, y0, sy FROM hexes)
        GROUP BY cu, cv, x0, sx, y0, sy""",
    "severe_topk": f"SELECT {_ints('recordingId', 'event_id', 'ego_id')}, {_rs('min_TTC_conf', 'conf_duration')} FROM severe",
    "severe_trajectories": f"""SELECT {_ints('recordingId', 'event_id', 'frame')}, {_rs('TTC', 'energy')} FROM phase
        WHERE (recordingId, event_id) IN (SELECT (recordingId, event_id) FROM severe)""",
    "cluster_input": f"""SELECT {_ints('rec_id', 'event_id')}, {_rs('min_TTC_conf', 'conf_duration', 'MEC_CO2_per_km', 'E_real_CO2_per_km')}
        FROM mec WHERE min_TTC_conf < 3 AND conf_duration >= 0.8 AND MEC_CO2_per_km IS NOT NULL""",
    "cluster_features": f"SELECT {_ints('rec_id', 'event_id')}, " + ", ".join(
        _r(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)", f"z_{c}")
        for c in ("min_TTC_conf", "conf_duration", "MEC_CO2_per_km", "E_real_CO2_per_km")) + """
        FROM mec WHERE min_TTC_conf < 3 AND conf_duration >= 0.8 AND MEC_CO2_per_km IS NOT NULL""",
    "cluster_facts": """SELECT count(*) AS n_events, 0::BIGINT AS n_out_of_range, 0::BIGINT AS n_not_nearest, 0::BIGINT AS n_out_of_order,
        count(*) AS n_in_summary FROM mec WHERE min_TTC_conf < 3 AND conf_duration >= 0.8 AND MEC_CO2_per_km IS NOT NULL""",
}
_QUERIES["mec_headline_of_older_names"] = _QUERIES["mec_headline"]
_QUERIES["episode_metrics_from_times"] = _QUERIES["episode_metrics"]

ORACLE = {name: _statement(sql) for name, sql in _QUERIES.items()}
