"""The trajectory queries in SQL, as common table expressions that build on each other."""

from __future__ import annotations

import re

from . import fixtures as fx

# What the queries should use, as plain values of its own: the SQL takes no constant from the operators that it checks.
FPS, GAP, KINEMATICS_WINDOW = 10, 10, 31
NX, NY = 32, 24
INTERPOLATED = ("confidence", "x1", "y1", "x2", "y2", "center_x", "center_y", "ground_x", "ground_y")
TELEMETRY_FIELDS = ("latitude", "longitude", "relative_altitude_m", "gimbal_yaw_deg", "gimbal_pitch_deg", "gimbal_roll_deg", "focal_length_35mm")
COLORS = ("black", "white", "silver_gray", "red", "orange", "yellow", "green", "blue", "purple")
SIZE_SHORT = {"small_passenger_vehicle": "S", "medium_passenger_vehicle": "M", "large_passenger_vehicle": "L", "two_wheeler": "2W", "heavy_vehicle": "HGV"}
COLOR_SHORT = {"silver_gray": "gray"}
SEG = "PARTITION BY track_id, segment_id"

CTES: dict[str, str] = {}


def _case(column: str, values: dict[str, object]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


CTES["frames"] = f"SELECT *, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // {fx.FRAME_MICROS} AS BIGINT) AS frame FROM events"
CTES["boxes"] = f"""
    SELECT event_id AS seq, frame, user_id AS track_id, {_case('event_type', {k: v[0] for k, v in fx.CLASSES.items()})} AS class_id,
           {_case('event_type', {k: f"'{v[1]}'" for k, v in fx.CLASSES.items()})} AS class_name, (event_id % 100) / 100 AS confidence, value AS x1,
           CAST(4 * CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS DOUBLE) AS y1, value + 10 + event_id % 90 AS x2, y1 + 8 + event_id % 41 AS y2 FROM frames"""
CTES["raw"] = f"""
    SELECT seq, frame, round(frame / {FPS}, 6) AS timestamp_s, track_id, class_id, class_name, round(confidence, 6) AS confidence, round(x1, 3) AS x1, round(y1, 3) AS y1, round(x2, 3) AS x2, round(y2, 3) AS y2,
           round((boxes.x1 + boxes.x2) / 2, 3) AS center_x, round((boxes.y1 + boxes.y2) / 2, 3) AS center_y, round((boxes.x1 + boxes.x2) / 2, 3) AS ground_x, round(boxes.y2, 3) AS ground_y FROM boxes"""
CTES["latest"] = "SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY track_id, frame ORDER BY seq DESC) = 1"


def _modes(name: str, source: str) -> None:
    CTES[f"{name}_ids"] = f"SELECT track_id, class_id FROM {source} GROUP BY track_id, class_id QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, class_id) = 1"
    CTES[f"{name}_modes"] = f"SELECT track_id, class_id, class_name FROM {source} SEMI JOIN {name}_ids USING (track_id, class_id) GROUP BY track_id, class_id, class_name QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, class_name) = 1"


_modes("latest", "latest")
_modes("raw", "raw")
CTES["consistency"] = "SELECT track_id, any_value(m.class_id) AS modal_class, avg(CAST(raw.class_id = m.class_id AS DOUBLE)) AS class_consistency FROM raw JOIN raw_ids m USING (track_id) GROUP BY track_id"


def _level(p: str, least: int) -> None:
    CTES[f"{p}_cut"] = f"""
        SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) > {GAP + 1} THEN 1 ELSE 0 END AS cut
        FROM (SELECT * FROM latest QUALIFY count(*) OVER (PARTITION BY track_id) >= {least})"""
    CTES[f"{p}_parts"] = f"SELECT *, track_id || '-' || CAST(sum(cut) OVER (PARTITION BY track_id ORDER BY frame) AS BIGINT) AS segment_id FROM {p}_cut"
    CTES[f"{p}_seg"] = f"SELECT * FROM {p}_parts QUALIFY count(*) OVER ({SEG}) >= {least}"
    CTES[f"{p}_spine"] = f"SELECT track_id, segment_id, unnest(frames) AS frame FROM (SELECT track_id, segment_id, range(min(frame), max(frame) + 1) AS frames FROM {p}_seg GROUP BY track_id, segment_id)"
    known = ", ".join(f"s.{c}" for c in INTERPOLATED)
    CTES[f"{p}_wide"] = f"SELECT d.track_id, d.segment_id, d.frame, d.frame / {FPS} AS timestamp_s, m.class_id, m.class_name, s.seq IS NOT NULL AS observed, {known} FROM {p}_spine d JOIN latest_modes m USING (track_id) LEFT JOIN {p}_seg s ON s.segment_id = d.segment_id AND s.frame = d.frame"
    sides = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER up AS a_{c}, first_value({c} IGNORE NULLS) OVER down AS b_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER up AS af_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER down AS bf_{c}" for c in INTERPOLATED
    )
    CTES[f"{p}_sides"] = f"SELECT *, {sides} FROM {p}_wide WINDOW up AS ({SEG} ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS ({SEG} ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    filled = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN a_{c} IS NULL THEN CASE WHEN bf_{c} - frame <= {GAP} THEN b_{c} END WHEN b_{c} IS NULL THEN CASE WHEN frame - af_{c} <= {GAP} THEN a_{c} END WHEN least(frame - af_{c}, bf_{c} - frame) <= {GAP} THEN a_{c} + (b_{c} - a_{c}) * ((frame - af_{c}) / (bf_{c} - af_{c})) END AS {c}"
        for c in INTERPOLATED
    )
    CTES[f"{p}_dense"] = f"SELECT track_id, segment_id, frame, timestamp_s, class_id, class_name, observed, count(*) OVER ({SEG}) AS n, {filled} FROM {p}_sides"

    def median(c: str) -> str:
        frames = {2: (1, 0), 3: (1, 1), 4: (2, 1)}
        whens = " ".join(f"WHEN {n} THEN median({c}) OVER ({SEG} ORDER BY frame ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)" for n, (a, b) in frames.items())
        return f"CASE n {whens} ELSE median({c}) OVER ({SEG} ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS {c}_smooth"

    CTES[f"{p}_clean"] = f"SELECT *, {median('ground_x')}, {median('ground_y')} FROM {p}_dense"


_level("l1", 5)
_level("l2", 10)
CTES["l1_speed"] = f"SELECT *, coalesce(sqrt(dx * dx + dy * dy), 0) / 0.1::DOUBLE AS speed_px_s FROM (SELECT *, ground_x_smooth - lag(ground_x_smooth) OVER w AS dx, ground_y_smooth - lag(ground_y_smooth) OVER w AS dy FROM l1_clean WINDOW w AS ({SEG} ORDER BY frame))"
CTES["l1_motion"] = f"SELECT *, coalesce(speed_px_s - lag(speed_px_s) OVER ({SEG} ORDER BY frame), 0) / 0.1::DOUBLE AS acceleration_px_s2 FROM l1_speed"
CTES["objects"] = """
    SELECT track_id, segment_id, min(class_id) AS class_id, min(class_name) AS class_name, min(timestamp_s) AS start_s, max(timestamp_s) AS end_s, max(timestamp_s) - min(timestamp_s) + 0.1::DOUBLE AS duration_s, avg(CAST(observed AS DOUBLE)) AS observed_ratio,
           any_value(class_consistency) AS class_consistency, sum(speed_px_s) * 0.1::DOUBLE AS path_length_px,
           sqrt(pow(arg_max(ground_x_smooth, frame) - arg_min(ground_x_smooth, frame), 2) + pow(arg_max(ground_y_smooth, frame) - arg_min(ground_y_smooth, frame), 2)) AS displacement_px,
           CASE WHEN sum(speed_px_s) > 0 THEN displacement_px / path_length_px ELSE 0 END AS straightness, avg(speed_px_s) AS mean_speed_px_s, quantile_cont(speed_px_s, 0.95) AS p95_speed_px_s, max(speed_px_s) AS max_speed_px_s
    FROM l1_motion JOIN consistency USING (track_id) GROUP BY track_id, segment_id"""
CTES["cells"] = f"SELECT CAST(least(floor(ground_x_smooth / {fx.WIDTH} * {NX}), {NX - 1}) AS INTEGER) AS bx, CAST(least(floor(ground_y_smooth / {fx.HEIGHT} * {NY}), {NY - 1}) AS INTEGER) AS by_, count(*) AS n FROM l1_clean WHERE ground_x_smooth BETWEEN 0 AND {fx.WIDTH} AND ground_y_smooth BETWEEN 0 AND {fx.HEIGHT} GROUP BY ALL"
CTES["taps"] = "SELECT CAST(range AS INTEGER) AS k, exp(-range * range / 8::DOUBLE) / sum(exp(-range * range / 8::DOUBLE)) OVER () AS weight FROM range(-8, 9)"
CTES["grid"] = f"SELECT a.range AS bx, b.range AS by_ FROM range({NX}) a, range({NY}) b"
CTES["filled"] = "SELECT g.bx, g.by_, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM grid g LEFT JOIN cells c ON g.bx = c.bx AND g.by_ = c.by_"
CTES["blur_x"] = f"SELECT g.bx, g.by_, sum(f.v * weight) AS v FROM grid g, taps JOIN filled f ON f.by_ = g.by_ AND f.bx = CASE WHEN abs(g.bx + k) >= {NX} THEN {2 * (NX - 1)} - abs(g.bx + k) ELSE abs(g.bx + k) END GROUP BY ALL"
CTES["blur_y"] = f"SELECT g.bx, g.by_, sum(f.v * weight) AS v FROM grid g, taps JOIN blur_x f ON f.bx = g.bx AND f.by_ = CASE WHEN abs(g.by_ + k) >= {NY} THEN {2 * (NY - 1)} - abs(g.by_ + k) ELSE abs(g.by_ + k) END GROUP BY ALL"


def _gradient(f: str, x: str = "timestamp_s") -> str:
    def at(c: str, k: int) -> str:
        return f"{'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER w" if k else c

    hs, hd = f"({x} - {at(x, -1)})", f"({at(x, 1)} - {x})"
    d1, d2 = hd, f"({at(x, 2)} - {at(x, 1)})"
    e1, e2 = f"({at(x, -1)} - {at(x, -2)})", hs
    return f"""CASE WHEN n = 1 THEN 0 WHEN n = 2 AND i = 1 THEN ({at(f, 1)} - {f}) / {hd} WHEN n = 2 THEN ({f} - {at(f, -1)}) / {hs}
        WHEN i = 1 THEN -(2 * {d1} + {d2}) / ({d1} * ({d1} + {d2})) * {f} + ({d1} + {d2}) / ({d1} * {d2}) * {at(f, 1)} - {d1} / ({d2} * ({d1} + {d2})) * {at(f, 2)}
        WHEN i = n THEN {e2} / ({e1} * ({e1} + {e2})) * {at(f, -2)} - ({e1} + {e2}) / ({e1} * {e2}) * {at(f, -1)} + (2 * {e2} + {e1}) / ({e2} * ({e1} + {e2})) * {f}
        ELSE ({hs} * {hs} * {at(f, 1)} + ({hd} * {hd} - {hs} * {hs}) * {f} - {hd} * {hd} * {at(f, -1)}) / ({hs} * {hd} * ({hs} + {hd})) END"""


def _kinematics(p: str, source: str, x: str, y: str, u: str) -> None:
    size = f"least(greatest(5, {KINEMATICS_WINDOW}), n) - CASE WHEN least(greatest(5, {KINEMATICS_WINDOW}), n) % 2 = 0 THEN 1 ELSE 0 END"
    CTES[f"{p}_place"] = f"SELECT * EXCLUDE (n), count(*) OVER ({SEG}) AS n, row_number() OVER ({SEG} ORDER BY timestamp_s) AS i, {x} AS fx, {y} AS fy FROM {source}"
    CTES[f"{p}_win"] = f"SELECT *, {size} AS w, (w - 1) // 2 AS h, greatest(1, least(i - h, n - w + 1)) AS b, CAST(i - b - h AS DOUBLE) AS e, h * (h + 1) * (2 * h + 1) / 3 AS s2, h * (h + 1) / 3 AS m2, h * (h + 1) * (2 * h + 1) * (3 * h * h + 3 * h - 1) / 15 - w * pow(h * (h + 1) / 3, 2) AS q FROM {p}_place"
    c = "(1 / a.w + a.e * (r.i - a.b - a.h) / a.s2 + (a.e * a.e - a.m2) * (pow(r.i - a.b - a.h, 2) - a.m2) / a.q)"
    CTES[f"{p}_fit"] = f"SELECT a.track_id, a.segment_id, a.i, sum({c} * r.fx) AS sx, sum({c} * r.fy) AS sy FROM {p}_win a JOIN {p}_place r ON r.track_id = a.track_id AND r.segment_id = a.segment_id AND r.i BETWEEN a.b AND a.b + a.w - 1 WHERE a.n >= 5 GROUP BY ALL"
    CTES[f"{p}_pos"] = f"SELECT p.*, coalesce(sx, fx) AS position_x_{u}, coalesce(sy, fy) AS position_y_{u} FROM {p}_place p LEFT JOIN {p}_fit f ON f.track_id = p.track_id AND f.segment_id = p.segment_id AND f.i = p.i"
    w = f"WINDOW w AS ({SEG} ORDER BY timestamp_s)"
    CTES[f"{p}_vel"] = f"SELECT *, {_gradient(f'position_x_{u}')} AS velocity_x_{u}_s, {_gradient(f'position_y_{u}')} AS velocity_y_{u}_s FROM {p}_pos {w}"
    CTES[f"{p}_speed"] = f"SELECT *, sqrt(velocity_x_{u}_s * velocity_x_{u}_s + velocity_y_{u}_s * velocity_y_{u}_s) AS speed_{u}_s FROM {p}_vel"
    CTES[f"{p}_acc"] = f"SELECT *, {_gradient(f'velocity_x_{u}_s')} AS acceleration_x_{u}_s2, {_gradient(f'velocity_y_{u}_s')} AS acceleration_y_{u}_s2, {_gradient(f'speed_{u}_s')} AS tangential_acceleration_{u}_s2 FROM {p}_speed {w}"
    CTES[f"{p}_kin"] = f"SELECT * EXCLUDE (i, fx, fy), sqrt(acceleration_x_{u}_s2 * acceleration_x_{u}_s2 + acceleration_y_{u}_s2 * acceleration_y_{u}_s2) AS acceleration_magnitude_{u}_s2 FROM {p}_acc"


#: The fixture's projection, solved by hand.
_MATRIX = ((1 / 16, 1 / 96, 0.0), (0.0, 5 / 64, 0.0), (0.0, 1 / 1920, 1.0))
#: The fixture's region, its corners in the order of growing angles.
_REGION = ((40, 440), (100, 60), (520, 60), (600, 440))


def _projection(x: str, y: str) -> tuple[str, str]:
    rows = [" + ".join(f"{float(v)!r}::DOUBLE * {c}" for v, c in zip(r, (x, y, "1"))) for r in _MATRIX]
    return f"({rows[0]}) / ({rows[2]})", f"({rows[1]}) / ({rows[2]})"


def _inside(x: str, y: str) -> str:
    corners = list(_REGION)
    return "(" + " AND ".join(f"({y} - {ay}) * ({bx - ax}) - ({x} - {ax}) * ({by - ay}) >= 0" for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1])) + ")"


_kinematics("px", "l2_clean", "ground_x_smooth", "ground_y_smooth", "px")
CTES["metric_in"] = f"SELECT *, {_projection('ground_x_smooth', 'ground_y_smooth')[0]} AS x_m, {_projection('ground_x_smooth', 'ground_y_smooth')[1]} AS y_m, {_inside('ground_x_smooth', 'ground_y_smooth')} AS inside_calibration_region FROM px_kin"
_kinematics("m", "metric_in", "x_m", "y_m", "m")
CTES["metric"] = "SELECT *, speed_m_s * 3.6::DOUBLE AS speed_kmh, speed_m_s < 0.5 AS stopped, 'surveyed' AS metric_calibration_quality FROM m_kin"
CTES["class_stats"] = f"""
    SELECT m.track_id, m.class_id, m.class_name, c.class_consistency AS raw_class_consistency, median(greatest(x2 - x1, 0)) AS median_box_width_px, median(greatest(y2 - y1, 0)) AS median_box_height_px, median(least(greatest(x2 - x1, 0), greatest(y2 - y1, 0))) * 0.06::DOUBLE AS estimated_plate_height_upper_bound_px,
           CASE WHEN estimated_plate_height_upper_bound_px < 12.0 THEN 'insufficient_resolution_for_validated_ocr' ELSE 'specialized_plate_detector_and_ocr_not_run' END AS plate_ocr_status
    FROM raw JOIN raw_modes m USING (track_id) JOIN consistency c USING (track_id) GROUP BY ALL"""
CTES["names"] = "SELECT track_id, class_name FROM raw GROUP BY track_id, class_name QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, class_name) = 1"
CTES["areas"] = "SELECT track_id, n.class_name, median(greatest(x2 - x1, 0) * greatest(y2 - y1, 0)) AS median_box_area_px2 FROM raw JOIN names n USING (track_id) GROUP BY ALL"
CTES["thirds"] = "SELECT CASE WHEN count(*) >= 3 THEN quantile_cont(median_box_area_px2, 0.33) ELSE median(median_box_area_px2) END AS low, CASE WHEN count(*) >= 3 THEN quantile_cont(median_box_area_px2, 0.67) ELSE median(median_box_area_px2) END AS high FROM areas WHERE class_name = 'car'"
CTES["sizes"] = f"""
    SELECT track_id, class_name, median_box_area_px2, CASE WHEN class_name = 'motorcycle' THEN 'two_wheeler' WHEN class_name = 'bus' THEN 'bus' WHEN class_name = 'truck' THEN 'heavy_vehicle' WHEN class_name <> 'car' THEN class_name
           WHEN median_box_area_px2 < low THEN 'small_passenger_vehicle' WHEN median_box_area_px2 > high THEN 'large_passenger_vehicle' ELSE 'medium_passenger_vehicle' END AS relative_size_class, 'scene-relative median detector-box area' AS size_method FROM areas, thirds"""
CTES["samples"] = """
    SELECT track_id, frame, seq FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY frame, seq) - 1 AS i, least(7, n) AS m FROM raw WHERE confidence >= 0.2)
    WHERE list_contains(list_transform(range(0, CAST(m AS BIGINT)), lambda j: CAST(round_even(j * CASE WHEN m > 1 THEN (n - 1) / (m - 1) ELSE 0 END, 0) AS BIGINT)), i)"""
CTES["pixels"] = "SELECT user_id AS track_id, frame, CAST(event_id * 37 % 256 AS INTEGER) AS b, CAST(event_id * 91 % 256 AS INTEGER) AS g, CAST(event_id * 53 % 256 AS INTEGER) AS r FROM frames"
CTES["hue"] = "SELECT *, greatest(b, g, r) AS v, v - least(b, g, r) AS d, CASE WHEN v = 0 THEN 0 ELSE CAST(round(d * 255 / v) AS INTEGER) END AS s, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b) * 60 / d WHEN v = g THEN (b - r) * 60 / d + 120 ELSE (r - g) * 60 / d + 240 END AS deg FROM pixels"
CTES["hsv"] = "SELECT * EXCLUDE (deg), CAST(round(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 2) AS INTEGER) % 180 AS h FROM hue"
CTES["painted"] = "SELECT *, CASE WHEN v < 48 THEN 'black' WHEN s < 45 AND v >= 205 THEN 'white' WHEN s < 45 THEN 'silver_gray' WHEN h < 10 OR h >= 170 THEN 'red' WHEN h < 22 THEN 'orange' WHEN h < 35 THEN 'yellow' WHEN h < 85 THEN 'green' WHEN h < 130 THEN 'blue' ELSE 'purple' END AS color FROM hsv"
_RANK = f"list_position([{', '.join(repr(c) for c in COLORS)}], color)"
CTES["frame_votes"] = f"SELECT track_id, frame, color, n / total AS confidence FROM (SELECT track_id, frame, color, count(*) AS n, sum(count(*)) OVER (PARTITION BY track_id, frame) AS total FROM painted GROUP BY track_id, frame, color) QUALIFY row_number() OVER (PARTITION BY track_id, frame ORDER BY n DESC, {_RANK}) = 1"
CTES["weights"] = "SELECT track_id, color, sum(greatest(0.05, confidence)) AS weight, min(frame) AS first, count(*) AS n FROM frame_votes GROUP BY ALL"
CTES["colors"] = "SELECT track_id, color AS dominant_color, round(weight / sum(weight) OVER t, 4) AS color_confidence, CAST(sum(n) OVER t AS BIGINT) AS color_samples FROM weights WINDOW t AS (PARTITION BY track_id) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY weight DESC, first) = 1"
_T = {"latitude": "47.25 + range * 1e-6", "longitude": "8.5 + range * 1e-6", "relative_altitude_m": "CASE WHEN range % 50 = 7 THEN 3 ELSE 100 + range % 10 END", "gimbal_yaw_deg": "(range * 7) % 360 - 180", "gimbal_pitch_deg": "-60 - range % 20", "gimbal_roll_deg": "range % 5 - 2", "focal_length_35mm": "24"}
CTES["telemetry"] = "SELECT range AS frame, " + ", ".join(f"CAST({_T[c]} AS DOUBLE) AS {c}" for c in TELEMETRY_FIELDS) + " FROM range(360) WHERE range % 97 <> 50"


CTES["clips"] = "SELECT CAST(s_suppkey AS BIGINT) AS clip, t.* REPLACE (relative_altitude_m + s_suppkey % 9 AS relative_altitude_m) FROM supplier, telemetry t WHERE (frame + s_suppkey) % 61 <> 7"


def _dense_telemetry(gap: int, source: str = "telemetry", key: str = "") -> str:
    w = f"({'PARTITION BY ' + key if key else ''} ORDER BY frame)"
    following = ", ".join(f"lead({c}) OVER {w} AS b_{c}" for c in TELEMETRY_FIELDS)
    share = "((pos - frame) / (b_frame - frame))"

    def value(c: str) -> str:
        line = f"{c} + {share} * ((b_{c} - {c} + 180 + 720) % 360 - 180)" if c in ("gimbal_yaw_deg", "gimbal_roll_deg") else f"{c} + {share} * (b_{c} - {c})"
        return f"CASE WHEN pos > frame THEN {line} ELSE {c} END AS {c}"

    return f"SELECT {key + ', ' if key else ''}pos AS frame, {', '.join(value(c) for c in TELEMETRY_FIELDS)}, pos > frame AS interpolated FROM (SELECT *, unnest(range(frame, CASE WHEN b_frame - frame - 1 BETWEEN 1 AND {gap} THEN b_frame ELSE frame + 1 END)) AS pos FROM (SELECT *, lead(frame) OVER {w} AS b_frame, {following} FROM {source}))"


CTES["telemetry_all"] = _dense_telemetry(2)
CTES["telemetry_own"] = _dense_telemetry(0)
CTES["clips_all"] = _dense_telemetry(2, "clips", "clip")
_F = f"(focal_length_35mm * {640 / 36!r}::DOUBLE)"
CTES["rays"] = f"""
    SELECT c.track_id, c.segment_id, c.frame, relative_altitude_m AS alt, gimbal_pitch_deg AS pitch, focal_length_35mm AS focal, longitude, latitude, (ground_x_smooth - {(fx.WIDTH - 1) / 2}) / {_F} AS rx, (ground_y_smooth - {(fx.HEIGHT - 1) / 2}) / {_F} AS ry,
           sin(radians(gimbal_yaw_deg)) AS sy, cos(radians(gimbal_yaw_deg)) AS cy, sin(radians(gimbal_pitch_deg)) AS sp, cos(radians(gimbal_pitch_deg)) AS cp, sin(radians(gimbal_roll_deg)) AS sr, cos(radians(gimbal_roll_deg)) AS cr
    FROM l2_clean c JOIN telemetry_all USING (frame)"""
CTES["directions"] = "SELECT *, sy * cp + rx * (cy * cr + sp * sy * sr) + ry * (sp * sy * cr - cy * sr) AS wx, cy * cp + rx * (-sy * cr + sp * cy * sr) + ry * (sp * cy * cr + sy * sr) AS wy, sp + rx * (-cp * sr) + ry * (-cp * cr) AS wz FROM rays"
CTES["landed"] = f"""
    SELECT *, CASE WHEN alt > 0 AND wz < -0.05 THEN -alt / wz END AS distance, radians(longitude - {fx.ORIGIN[1]}) * 6378137.0 * cos(radians({fx.ORIGIN[0]})) + distance * wx AS x_m, radians(latitude - {fx.ORIGIN[0]}) * 6378137.0 + distance * wy AS y_m,
           coalesce(pitch <= -20 AND alt BETWEEN 5 AND 500 AND focal BETWEEN 10 AND 200 AND distance <= alt * 10, FALSE) AS inside FROM directions"""


def _insights(name: str, source: str, metric: bool) -> None:
    good = "inside_calibration_region"
    more = "0::DOUBLE AS metric_coverage_ratio, FALSE AS metric_kinematics_reliable"
    if metric:
        more = f"""avg(CAST({good} AS DOUBLE)) AS metric_coverage_ratio, avg(speed_m_s) FILTER ({good}) AS mean_speed_m_s, quantile_cont(speed_m_s, 0.95) FILTER ({good}) AS p95_speed_m_s, avg(speed_kmh) FILTER ({good}) AS mean_speed_kmh,
            quantile_cont(speed_kmh, 0.95) FILTER ({good}) AS p95_speed_kmh, quantile_cont(acceleration_magnitude_m_s2, 0.95) FILTER ({good}) AS p95_acceleration_m_s2, count(*) FILTER ({good} AND stopped) * 0.1::DOUBLE AS stopped_duration_s,
            duration_s >= 2 AND observed_ratio >= 0.7 AND metric_coverage_ratio >= 0.8 AS metric_kinematics_reliable"""
    CTES[f"{name}_seg"] = f"""
        SELECT track_id, segment_id, min(timestamp_s) AS start_s, max(timestamp_s) AS end_s, max(timestamp_s) - min(timestamp_s) + 0.1::DOUBLE AS duration_s, avg(CAST(observed AS DOUBLE)) AS observed_ratio, avg(speed_px_s) AS mean_speed_px_s, quantile_cont(speed_px_s, 0.95) AS p95_speed_px_s,
               sqrt(pow(arg_max(position_x_px, frame) - arg_min(position_x_px, frame), 2) + pow(arg_max(position_y_px, frame) - arg_min(position_y_px, frame), 2)) AS displacement_px, {more}
        FROM {source} GROUP BY track_id, segment_id"""
    CTES[name] = f"SELECT s.*, c.* EXCLUDE (track_id), a.* EXCLUDE (track_id), z.* EXCLUDE (track_id, class_name) FROM {name}_seg s LEFT JOIN class_stats c USING (track_id) LEFT JOIN colors a USING (track_id) LEFT JOIN sizes z USING (track_id)"


_insights("insights", "px_kin", False)
_insights("insights_m", "metric", True)
CTES["first_rows"] = "SELECT * FROM insights QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY start_s, segment_id) = 1"
CTES["longest"] = "SELECT * FROM objects QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(duration_s, 9) DESC, segment_id) = 1"
CTES["scored"] = "SELECT raw.*, confidence * sqrt(greatest(greatest(x2 - x1, 0) * greatest(y2 - y1, 0), 1)) AS display_score FROM raw SEMI JOIN (SELECT * FROM longest WHERE duration_s >= 2 AND displacement_px >= 12) USING (track_id) WHERE confidence >= 0.2"
CTES["shown"] = "SELECT *, CAST(row_number() OVER (PARTITION BY frame ORDER BY display_score DESC, seq) AS INTEGER) AS place, CAST(trunc(x1 * 0.5) AS INTEGER) AS ox1, CAST(trunc(y1 * 0.5) AS INTEGER) AS oy1, CAST(trunc(x2 * 0.5) AS INTEGER) AS ox2, CAST(trunc(y2 * 0.5) AS INTEGER) AS oy2 FROM scored QUALIFY place <= 12"
CTES["longest_i"] = "SELECT * FROM insights QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(duration_s, 9) DESC, segment_id) = 1"
CTES["longest_m"] = "SELECT * FROM insights_m QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(duration_s, 9) DESC, segment_id) = 1"
CTES["top12"] = "SELECT track_id, segment_id FROM objects ORDER BY round(duration_s, 9) DESC, track_id, segment_id LIMIT 12"


def _needed(sql: str) -> list[str]:
    names = set(re.findall(r"\w+", sql)) & set(CTES)
    while True:
        more = {w for n in names for w in re.findall(r"\w+", CTES[n]) if w in CTES} | names
        if more == names:
            return [n for n in CTES if n in names]
        names = more


def _sql(source: str, exact: str = "", doubles: str = "", places: int = 6, tail: str = "") -> str:
    columns = [*exact.split(), *(f"round({c}, {places}) + 0 AS {c}" for c in doubles.split())]
    body = f"SELECT {', '.join(columns)} FROM {source} {tail}"
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in _needed(body)) + "\n" + body


def _plain(body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in _needed(body)) + "\n" + body


_KEYS = "track_id segment_id frame"
_OBJ = "start_s end_s duration_s observed_ratio mean_speed_px_s p95_speed_px_s displacement_px metric_coverage_ratio raw_class_consistency median_box_width_px median_box_height_px estimated_plate_height_upper_bound_px color_confidence median_box_area_px2"
_OBJ_EXACT = "track_id segment_id metric_kinematics_reliable class_id class_name plate_ocr_status dominant_color color_samples relative_size_class size_method"


def _short(column: str, names: dict[str, str]) -> str:
    return f"CASE coalesce({column}, 'unknown') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE coalesce({column}, 'unknown') END"


def _packing_sql(width: int, height: int) -> str:
    """Labels of a frame one after the other: of three places the first that is free, 7 pixels a character, text 9 high, baseline 4."""
    label = f"'#' || s.track_id || ' ' || {_short('l.dominant_color', COLOR_SHORT)} || ' ' || {_short('l.relative_size_class', SIZE_SHORT)}"
    CTES["labelled"] = f"SELECT s.frame, s.place, 7 * length({label}) AS wide, s.ox1, s.oy1, s.ox2, s.oy2 FROM shown s JOIN longest_i l USING (track_id)"
    CTES["ordered"] = "SELECT *, row_number() OVER (PARTITION BY frame ORDER BY place) AS turn FROM labelled"
    places = (("0", "ox1", "oy1 - 20"), ("1", "ox1", "oy2 + 20"), ("2", "ox2 + 3", "oy1 + 12"))
    options = ", ".join(f"{{'slot': {k}, 'l': greatest(0, {x} - 2), 't': greatest(0, {y} - 12), 'r': least({width - 1}, {x} + wide + 3), 'b': least({height - 1}, {y} + 6)}}" for k, x, y in places)
    CTES["offers"] = f"SELECT frame, turn, place, list_filter([{options}], lambda o: o.r > o.l AND o.b > o.t) AS offers FROM ordered"
    needed = _needed("SELECT * FROM offers")
    fits = "list_filter(o.offers, lambda x: len(list_filter(p.taken, lambda u: x.l < u.r AND x.r > u.l AND x.t < u.b AND x.b > u.t)) = 0)[1]"
    return (
        "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + f""",
        packed AS (
            SELECT frame, CAST(0 AS BIGINT) AS turn, CAST(NULL AS INTEGER) AS place, CAST(NULL AS STRUCT(slot INTEGER, l INTEGER, t INTEGER, r INTEGER, b INTEGER)) AS best, CAST([] AS STRUCT(slot INTEGER, l INTEGER, t INTEGER, r INTEGER, b INTEGER)[]) AS taken FROM (SELECT DISTINCT frame FROM offers)
            UNION ALL
            SELECT frame, turn, place, best, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END
            FROM (SELECT o.frame, o.turn, o.place, CAST({fits} AS STRUCT(slot INTEGER, l INTEGER, t INTEGER, r INTEGER, b INTEGER)) AS best, p.taken FROM packed p JOIN offers o ON o.frame = p.frame AND o.turn = p.turn + 1))
        SELECT frame, place, coalesce(best.slot, -1) AS slot, coalesce(best.l, -1) AS "left", coalesce(best.t, -1) AS top, coalesce(best.r, -1) AS "right", coalesce(best.b, -1) AS bottom FROM packed WHERE turn > 0"""
    )


def _suppression_sql(least: float) -> str:
    """Boxes of a frame and class by falling confidence: each goes if it overlaps one that was kept by more than least."""
    box = "STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)"
    shared = "greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1))"
    area = "greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1)"
    CTES["turns"] = "SELECT frame, class_id, seq, x1, y1, x2, y2, row_number() OVER (PARTITION BY frame, class_id ORDER BY confidence DESC, seq) AS turn FROM raw"
    hit = f"len(list_filter(p.kept, lambda k: {shared} > {least} * ({area.format('k')} + {area.format('o')} - {shared}))) > 0"
    return (
        "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in _needed("SELECT * FROM turns")) + f""",
        w AS (
            SELECT frame, class_id, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS seq, FALSE AS hit, CAST([] AS {box}[]) AS kept FROM (SELECT DISTINCT frame, class_id FROM turns)
            UNION ALL
            SELECT frame, class_id, turn, seq, hit, CASE WHEN hit THEN kept ELSE list_append(kept, own) END
            FROM (SELECT o.frame, o.class_id, o.turn, o.seq, {hit} AS hit, p.kept, CAST({{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}} AS {box}) AS own FROM w p JOIN turns o ON o.frame = p.frame AND o.class_id = p.class_id AND o.turn = p.turn + 1))
        SELECT frame, class_id, seq FROM w WHERE turn > 0 AND NOT hit"""
    )


_CORNERS = f"""SELECT seq, greatest(0, least(CAST(round_even(x1, 0) AS INTEGER), {fx.WIDTH - 1})) AS a, greatest(0, least(CAST(round_even(y1, 0) AS INTEGER), {fx.HEIGHT - 1})) AS b,
    least(greatest(CAST(round_even(x2, 0) AS INTEGER), a + 1), {fx.WIDTH}) AS c, least(greatest(CAST(round_even(y2, 0) AS INTEGER), b + 1), {fx.HEIGHT}) AS d,
    greatest(1, CAST(round_even((c - a) * 0.22::DOUBLE, 0) AS INTEGER)) AS dx, greatest(1, CAST(round_even((d - b) * 0.22::DOUBLE, 0) AS INTEGER)) AS dy FROM raw"""
CTES["corners"] = _CORNERS
CTES["crops"] = "SELECT seq, a + dx AS x1, b + dy AS y1, c - dx AS x2, d - dy AS y2 FROM corners WHERE c - a >= 4 AND d - b >= 4 AND c - a > dx * 2 AND d - b > dy * 2"
CTES["crop_sizes"] = "SELECT DISTINCT x2 - x1 AS w, y2 - y1 AS h FROM crops"
CTES["crop_cells"] = "SELECT w, h, x, unnest(range(h)) AS y FROM (SELECT w, h, unnest(range(w)) AS x FROM crop_sizes)"

ORACLE_SQL: dict[str, str] = {
    "counted_seconds_stream": _plain("SELECT CAST(frame // 10 AS BIGINT) AS second, class_name, count(DISTINCT track_id) AS visible_objects FROM raw GROUP BY ALL"),
    "ordered_trails_stream": _plain("SELECT frame, track_id, seq, CAST(count(*) OVER w AS INTEGER) AS points, CAST(sum(floor(ground_x) + floor(ground_y)) OVER w AS BIGINT) AS sum_xy FROM raw WINDOW w AS (PARTITION BY track_id ORDER BY frame, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"),
    "first_appearance": _plain("SELECT track_id, row_number() OVER (ORDER BY first, track_id) AS place FROM (SELECT track_id, min({'frame': frame, 'seq': seq}) AS first FROM raw GROUP BY track_id)"),
    "stable_tracks": _plain("SELECT track_id, segment_id FROM longest_i WHERE round(duration_s, 9) >= 2 AND raw_class_consistency >= 0.3 AND color_confidence >= 0.3 AND displacement_px >= 12"),
    "label_packing": _packing_sql(fx.WIDTH // 2, fx.HEIGHT // 2),
    "suppressed_boxes": _suppression_sql(0.2),
    "crop_windows": _plain("SELECT seq, x1, y1, x2, y2 FROM crops"),
    "ellipse_pixels": _plain("SELECT CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, count(*) AS pixels FROM crop_cells WHERE pow((x - w // 2) / greatest(1, w // 2 - 1), 2) + pow((y - h // 2) / greatest(1, h // 2 - 1), 2) <= 1 GROUP BY ALL"),
    "missing_frames_offset": _plain("SELECT DISTINCT frame + 30 AS frame FROM l2_clean WHERE frame + 30 NOT IN (SELECT frame FROM telemetry_own) ORDER BY 1 LIMIT 10"),
    "annotation_plan": _plain("SELECT frame, track_id, seq, '#' || track_id || ' ' || class_name AS label, CAST(count(*) OVER w AS INTEGER) AS points, CAST(sum(floor(ground_x) + floor(ground_y)) OVER w AS BIGINT) AS sum_xy FROM raw WHERE frame % 2 = 0 WINDOW w AS (PARTITION BY track_id ORDER BY frame, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"),
    "box_colours": _plain("SELECT track_id, c[1] AS b, c[2] AS g, c[3] AS r FROM (SELECT track_id, CASE dominant_color WHEN 'black' THEN [80, 80, 80] WHEN 'white' THEN [245, 245, 245] WHEN 'silver_gray' THEN [180, 180, 180] WHEN 'red' THEN [40, 40, 230] WHEN 'orange' THEN [40, 150, 245] WHEN 'yellow' THEN [40, 225, 245] WHEN 'green' THEN [70, 200, 70] WHEN 'blue' THEN [230, 130, 40] WHEN 'purple' THEN [210, 80, 200] ELSE [255, 255, 255] END AS c FROM (SELECT DISTINCT track_id FROM raw) LEFT JOIN colors USING (track_id))"),
    "raw_tracks_projection": _sql("raw", "seq frame track_id class_id class_name", "timestamp_s confidence x1 y1 x2 y2 center_x center_y ground_x ground_y"),
    "stride_time_class_filter": _sql("raw", "seq frame track_id class_id", "confidence", tail="WHERE frame % 2 = 0 AND frame < 300 AND class_id IN (2, 3, 5, 7) AND confidence >= 0.05"),
    "dedupe_keep_last": _sql("latest", "track_id frame seq"),
    "track_mode_class": _sql("latest_modes", "track_id class_id class_name"),
    "class_consistency": _sql("consistency", "track_id modal_class", "class_consistency"),
    "gap_segments": _plain("SELECT track_id, segment_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS rows FROM l1_seg GROUP BY ALL"),
    "dense_interpolated": _sql("l1_dense", f"{_KEYS} class_id observed", "timestamp_s confidence x1 y1 x2 y2 ground_x ground_y"),
    "rolling_median_smooth": _sql("l1_clean", _KEYS, "ground_x_smooth ground_y_smooth"),
    "pixel_motion": _sql("l1_motion", _KEYS, "speed_px_s acceleration_px_s2"),
    "object_metrics": _sql("objects", "track_id segment_id class_id class_name", "start_s end_s duration_s observed_ratio class_consistency path_length_px displacement_px straightness mean_speed_px_s p95_speed_px_s max_speed_px_s"),
    "timeseries_counts": _plain("""SELECT second, class_name, visible_objects, all_visible_objects FROM (SELECT CAST(floor(timestamp_s) AS BIGINT) AS second, class_name, count(DISTINCT track_id) AS visible_objects FROM l1_clean WHERE observed GROUP BY ALL)
        JOIN (SELECT CAST(floor(timestamp_s) AS BIGINT) AS second, count(DISTINCT track_id) AS all_visible_objects FROM l1_clean WHERE observed GROUP BY ALL) USING (second)"""),
    "tracking_quality": _plain("""SELECT count(DISTINCT track_id) AS unique_tracks, round(median(duration_s), 3) AS median_track_duration_s, round(avg(CAST(duration_s >= 2 AS DOUBLE)), 4) AS long_track_ratio, round(median(observed_ratio), 4) AS median_observed_ratio,
        round(median(class_consistency), 4) AS median_class_consistency, (SELECT count(*) FROM raw) AS tracked_detections, 10.0::DOUBLE AS fps FROM objects"""),
    "tracks_by_class": _plain("SELECT class_name, count(DISTINCT track_id) AS tracks FROM objects GROUP BY ALL"),
    "density_histogram": _plain("SELECT bx, by_ AS by, n FROM cells"),
    "density_blur": _plain("SELECT CAST(bx AS INTEGER) AS bx, CAST(by_ AS INTEGER) AS by, round(v, 6) + 0 AS density FROM blur_y"),
    "savgol_smooth": _sql("px_kin", _KEYS, "position_x_px position_y_px"),
    "gradient_velocity": _sql("px_kin", _KEYS, "velocity_x_px_s velocity_y_px_s speed_px_s acceleration_x_px_s2 acceleration_y_px_s2 acceleration_magnitude_px_s2 tangential_acceleration_px_s2", 5),
    "heading_px": _plain("SELECT track_id, segment_id, frame, round((degrees(atan2(round(dy, 6), round(dx, 6))) + 360) % 360, 4) % 360 AS heading_deg FROM l1_speed WHERE dx IS NOT NULL AND (abs(dx) > 1e-6 OR abs(dy) > 1e-6)"),
    "class_statistics": _sql("class_stats", "track_id class_id class_name plate_ocr_status", "raw_class_consistency median_box_width_px median_box_height_px estimated_plate_height_upper_bound_px"),
    "relative_size": _sql("sizes", "track_id class_name relative_size_class size_method", "median_box_area_px2"),
    "colour_samples": _sql("samples", "track_id frame seq"),
    "hsv_family": _plain("SELECT h, s, v, color, count(*) AS n FROM painted GROUP BY ALL"),
    "pixel_vote": _sql("frame_votes", "track_id frame color", "confidence"),
    "track_colour_vote": _sql("colors", "track_id dominant_color color_samples", "color_confidence", 4),
    "homography_project": _plain(f"SELECT track_id, segment_id, frame, round({_projection('ground_x_smooth', 'ground_y_smooth')[0]} + 1e-9, 6) + 0 AS x_m, round({_projection('ground_x_smooth', 'ground_y_smooth')[1]} + 1e-9, 6) + 0 AS y_m FROM l1_clean"),
    "inside_hull": _plain(f"SELECT track_id, segment_id, frame, {_inside('ground_x_smooth', 'ground_y_smooth')} AS inside FROM l1_clean"),
    "telemetry_segments": _plain("SELECT clip, place, frame, CAST(sum(reset) OVER (PARTITION BY clip ORDER BY place) AS BIGINT) AS segment FROM (SELECT clip, frame AS place, frame % 100 AS frame, CASE WHEN frame % 100 <= lag(frame % 100) OVER (PARTITION BY clip ORDER BY frame) THEN 1 ELSE 0 END AS reset FROM clips)"),
    "srt_parse": _plain("SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY t.frame) - 1 AS place, t.frame % 40 AS frame, CAST(t.frame // 40 AS BIGINT) AS segment, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in TELEMETRY_FIELDS) + " FROM clips t WHERE t.frame < 80"),
    "telemetry_dense": _sql("clips_all", "clip frame interpolated", " ".join(TELEMETRY_FIELDS), 7),
    "telemetry_project": _sql("landed", f"{_KEYS} inside", "x_m y_m", 5),
    "telemetry_report": _plain("SELECT min(frame) AS first_frame, max(frame) AS last_frame, " + ", ".join(f"{k}({c}) AS {k}_{c}" for c in ("relative_altitude_m", "gimbal_pitch_deg", "gimbal_yaw_deg", "focal_length_35mm") for k in ("min", "max")) + ", (SELECT count(*) FROM telemetry_all SEMI JOIN l2_clean USING (frame) WHERE interpolated) AS interpolated_frame_count FROM telemetry"),
    "missing_frames": _plain("SELECT DISTINCT frame FROM l2_clean ANTI JOIN telemetry_own USING (frame) ORDER BY frame LIMIT 10"),
    "metric_kinematics": _sql("metric", f"{_KEYS} inside_calibration_region metric_calibration_quality", "position_x_m position_y_m speed_m_s speed_kmh acceleration_magnitude_m_s2", 5),
    "object_insights": _sql("insights", _OBJ_EXACT, _OBJ, 5),
    "object_insights_metric": _sql("insights_m", _OBJ_EXACT, f"{_OBJ} mean_speed_m_s p95_speed_m_s mean_speed_kmh p95_speed_kmh p95_acceleration_m_s2 stopped_duration_s", 5),
    "level2_distributions": _plain("""SELECT kind, label, count(*) AS tracks FROM (SELECT 'color' AS kind, coalesce(dominant_color, 'unknown') AS label FROM first_rows UNION ALL SELECT 'size', coalesce(relative_size_class, 'unknown') FROM first_rows
        UNION ALL SELECT 'plate', plate_ocr_status FROM first_rows WHERE plate_ocr_status IS NOT NULL) GROUP BY ALL"""),
    "metric_summary": _plain("""SELECT 'measured' AS metric_status, 'surveyed' AS projection_quality, count(DISTINCT track_id) AS metric_reliable_objects, round(median(mean_speed_kmh), 3) AS median_mean_speed_kmh, round(median(p95_speed_kmh), 3) AS median_p95_speed_kmh, round(median(p95_acceleration_m_s2), 3) AS median_p95_acceleration_m_s2,
        CASE WHEN quantile_cont(p95_speed_kmh, 0.99) < 80 AND quantile_cont(p95_acceleration_m_s2, 0.95) < 8 THEN 'pass' ELSE 'review_required' END AS plausibility_check FROM insights_m WHERE metric_kinematics_reliable"""),
    "longest_segment": _sql("longest", "track_id segment_id", "duration_s"),
    "top_segments_profile": _plain("SELECT track_id, segment_id, round(timestamp_s, 6) AS timestamp_s, round(speed_px_s, 6) + 0 AS speed FROM l1_motion SEMI JOIN top12 USING (track_id, segment_id)"),
    "evidence_topk": _sql("shown", "frame track_id seq place ox1 oy1 ox2 oy2", "display_score"),
    "evidence_trails": _plain("""SELECT frame, track_id, seq, CAST(count(*) OVER w AS INTEGER) AS points, CAST(sum((ox1 + ox2) // 2 + oy2) OVER w AS BIGINT) AS sum_xy FROM shown WINDOW w AS (PARTITION BY track_id ORDER BY frame, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""),
    "label_text": _plain(f"""SELECT s.frame, s.track_id, s.seq, '#' || s.track_id || ' ' || {_short('l.dominant_color', COLOR_SHORT)} || ' ' || {_short('l.relative_size_class', SIZE_SHORT)} || CASE WHEN k.inside_calibration_region THEN ' ~' || CAST(round_even(k.speed_kmh, 0) AS BIGINT) || 'km/h' ELSE '' END AS label
        FROM shown s JOIN longest_m l USING (track_id) LEFT JOIN metric k ON k.frame = s.frame AND k.track_id = s.track_id"""),
    "label_overlap_pairs": _plain("SELECT a.frame, CAST(a.place AS INTEGER) AS a, CAST(b.place AS INTEGER) AS b FROM shown a JOIN shown b ON a.frame = b.frame AND a.place < b.place AND a.ox1 < b.ox2 AND a.ox2 > b.ox1 AND a.oy1 < b.oy2 AND a.oy2 > b.oy1"),
    "session_segments_stream": _plain(f"""SELECT track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS rows FROM (SELECT *, sum(cut) OVER (PARTITION BY track_id ORDER BY frame, seq) AS part FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame, seq) > {GAP + 1} THEN 1 ELSE 0 END AS cut FROM raw)) GROUP BY track_id, part"""),
    "tumbling_counts_stream": _plain(f"SELECT CAST(frame // {FPS} AS BIGINT) AS second, class_name, count(DISTINCT track_id) AS visible_objects FROM raw GROUP BY ALL"),
}
