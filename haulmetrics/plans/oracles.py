"""Plain-SQL answers to the named queries, written against the driver's tables for DuckDB.

`BLOCKS` holds named sub-selects in dependency order. A check names the block it reads and the
columns it reports; the blocks it needs are found by name and put in front as a WITH list.
"""

import re

from haulmetrics.operators import features, route

# Settles rounding ties the same way as the Spark side.
NUDGE = "1e-9::DOUBLE"


def km(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0::DOUBLE * asin(sqrt({_chord(a, b, c, d)}))"


def metres(a: str, b: str, c: str, d: str) -> str:
    h = _chord(a, b, c, d)
    return f"6371000.0::DOUBLE * 2 * atan2(sqrt({h}), sqrt(1 - ({h})))"


def _chord(a: str, b: str, c: str, d: str) -> str:
    return (f"pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) "
            f"* pow(sin((radians({d}) - radians({b})) / 2), 2)")


def bearing(a: str, b: str, c: str, d: str) -> str:
    dl = f"(radians({d}) - radians({b}))"
    return (f"degrees(atan2(sin({dl}) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) "
            f"- sin(radians({a})) * cos(radians({c})) * cos({dl})))")


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({low}::DOUBLE, least({x}, {high}::DOUBLE)) END"


HAV = km("lat_prev", "lon_prev", "lat", "lon")
ENDS = ("lat_start", "lon_start", "lat_end", "lon_end")

BLOCKS: dict[str, str] = {
    # telemetry view
    "b": "SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, epoch_us(ts) AS us FROM events",
    "r": """SELECT event_id, event_type, value, k,
      concat('VH', lpad(CAST(CAST(floor(user_id / CAST(15.0 AS DOUBLE)) AS INT) AS VARCHAR), 4, '0')) AS vehicle_id,
      CAST(1704067200 + floor((us / CAST(1000000.0 AS DOUBLE) - 1704067200) / CAST(10.0 AS DOUBLE)) AS BIGINT) AS s,
      NOT (event_type = 'error' AND k < 50) AS engine_on, NOT (event_type = 'signup' AND k < 25) AS gps_ok,
      CASE WHEN event_type = 'view' OR (event_type = 'error' AND k < 50) THEN CAST(0.0 AS DOUBLE)
           ELSE least(value, CAST(135.0 AS DOUBLE)) END AS speed FROM b""",
    "d": "SELECT *, row_number() OVER (PARTITION BY vehicle_id, s ORDER BY event_id) AS rn FROM r",
    "w": "SELECT *, s - lag(s) OVER (PARTITION BY vehicle_id ORDER BY s, event_id) AS dt FROM d",
    "m": "SELECT *, CAST(floor(coalesce(least(dt, 900), 0) * speed / CAST(3.6 AS DOUBLE)) AS BIGINT) AS step_m FROM w",
    "c": """SELECT *, sum(step_m) OVER z AS odo,
      sum(CASE k % 4 WHEN 0 THEN step_m WHEN 2 THEN -step_m ELSE 0 END) OVER z AS ym,
      sum(CASE k % 4 WHEN 1 THEN step_m WHEN 3 THEN -step_m ELSE 0 END) OVER z AS xm
      FROM m WINDOW z AS (PARTITION BY vehicle_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)""",
    "tall": """SELECT vehicle_id, s, event_id, k, engine_on, gps_ok, speed AS speed_kmh, rn,
      CASE WHEN k = 98 THEN NULL WHEN k = 97 THEN 50000 + odo / CAST(1000.0 AS DOUBLE) - 5
           ELSE 50000 + odo / CAST(1000.0 AS DOUBLE) END AS odometer_km,
      CAST(3.1 AS DOUBLE) + ym / CAST(111195.0 AS DOUBLE) + CASE WHEN k = 96 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS lat,
      CAST(101.6 AS DOUBLE) + xm / CAST(111195.0 AS DOUBLE) AS lon,
      CAST((k * 37 + event_id) % 361 AS BIGINT) AS direction, CAST(k AS DOUBLE) AS fuel_level FROM c""",
    "t": "SELECT * FROM tall WHERE rn = 1",
    "raw": """SELECT CASE WHEN event_id % 97 = 0 THEN 'not a time' ELSE strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') END AS "Timestamp",
      CASE WHEN event_id % 89 <> 0 THEN vehicle_id END AS CarNumberPlate,
      CAST(lat AS VARCHAR) AS Latitude, CAST(lon AS VARCHAR) AS Longitude,
      CASE WHEN event_id % 83 = 0 THEN 'n/a' ELSE CAST(speed_kmh AS VARCHAR) END AS Speed,
      CASE WHEN event_id % 79 <> 0 THEN CASE WHEN engine_on
        THEN CASE event_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'ON' ELSE '1' END
        ELSE CASE event_id % 3 WHEN 0 THEN 'False' WHEN 1 THEN 'OFF' ELSE '0' END END END AS EngineStatus,
      CAST(odometer_km AS VARCHAR) AS Odometer,
      CASE WHEN k = 95 THEN '' ELSE CAST(k AS VARCHAR) END AS FuelLevelPercentage,
      CASE WHEN event_id % 73 <> 0 THEN CASE WHEN gps_ok THEN 'True' ELSE 'False' END END AS GPSLocated,
      CAST(direction AS VARCHAR) AS Direction, CASE WHEN k >= 60 THEN concat('n', k) END AS Note, event_id AS row_id FROM tall""",
    "typed": """SELECT CAST(epoch(TRY_CAST("Timestamp" AS TIMESTAMP)) AS BIGINT) AS ts, CarNumberPlate AS vehicle_id,
      coalesce(upper(EngineStatus) IN ('TRUE', '1', 'ON'), false) AS engine_on, coalesce(upper(GPSLocated) IN ('TRUE', '1'), false) AS gps_ok,
      TRY_CAST(Speed AS DOUBLE) AS speed_kmh, row_id FROM raw""",
    # pings
    "st0": """SELECT *, lag(s) OVER v AS s_prev, lag(lat) OVER v AS lat_prev, lag(lon) OVER v AS lon_prev, lag(odometer_km) OVER v AS odo_prev,
      lag(engine_on) OVER v AS engine_prev,
      median(speed_kmh) OVER (PARTITION BY vehicle_id ORDER BY s ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS speed_smoothed
      FROM t WINDOW v AS (PARTITION BY vehicle_id ORDER BY s)""",
    "st1": f"""SELECT *, (s - s_prev) / 3600.0::DOUBLE AS time_delta_hours, {HAV} AS gps_step_raw, odometer_km - odo_prev AS odo_step_km,
      (coalesce(engine_prev, false) = false AND engine_on) OR coalesce((s - s_prev) / 60.0::DOUBLE >= 15, false) AS starts_trip FROM st0""",
    "st2": """SELECT *, time_delta_hours * 60 AS time_delta_min, CASE WHEN time_delta_hours > 0 THEN gps_step_raw / time_delta_hours END AS implied_speed_kmh,
      coalesce(odo_step_km < 0, false) OR coalesce(odo_step_km > 50 AND time_delta_hours < 60 / 3600.0::DOUBLE, false) AS invalid_odo_step FROM st1""",
    "st3": """SELECT *, coalesce(implied_speed_kmh > 140, false) AS teleport,
      CASE WHEN NOT coalesce(implied_speed_kmh > 140, false) AND gps_ok THEN gps_step_raw END AS gps_step_km FROM st2""",
    "st": """SELECT *, CASE WHEN gps_ok AND gps_step_km IS NOT NULL AND odo_step_km >= 0.01 AND odo_step_km <= 5.0 AND NOT invalid_odo_step
      AND implied_speed_kmh <= 120 THEN gps_step_km / odo_step_km END AS odo_gps_ratio FROM st3""",
    "sf": """SELECT vehicle_id, greatest(0.8::DOUBLE, least(1.2::DOUBLE, quantile_cont(odo_gps_ratio, 0.5))) AS scale
      FROM st WHERE odo_gps_ratio IS NOT NULL GROUP BY vehicle_id""",
    "p0": """SELECT st.*, coalesce(scale, 1.0::DOUBLE) AS scale_factor, odo_step_km IS NOT NULL AND NOT invalid_odo_step AND odo_step_km >= 0 AS from_odometer
      FROM st LEFT JOIN sf USING (vehicle_id)""",
    "p1": """SELECT *, NOT from_odometer AND gps_step_km IS NOT NULL AS from_gps,
      CASE WHEN from_odometer THEN odo_step_km * scale_factor WHEN gps_step_km IS NOT NULL THEN gps_step_km ELSE 0.0::DOUBLE END AS fused_step_km FROM p0""",
    "p": """SELECT *, fused_step_km = 0 AND gps_step_km IS NULL AND (odo_step_km IS NULL OR invalid_odo_step) AS distance_missing,
      NOT gps_ok AND coalesce(speed_smoothed > 120, false) AS flagged_over120, gps_ok AND coalesce(speed_smoothed > 120, false) AS speeding_over120,
      NOT gps_ok AND coalesce(speed_smoothed > 120, false) AS exclude_from_metrics,
      engine_on AND coalesce(speed_smoothed < 1, false) AS is_idle, engine_on AND coalesce(speed_smoothed >= 1, false) AS is_moving,
      CAST(sum(CASE WHEN starts_trip THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip_id,
      CAST(sum(CASE WHEN starts_trip AND s_prev IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS legacy_trip_id
      FROM p1""",
    # hybrid trips and days
    "ht0": """SELECT vehicle_id, trip_id, min(s) FILTER (NOT exclude_from_metrics) AS Trip_Start_UTC, max(s) FILTER (NOT exclude_from_metrics) AS Trip_End_UTC,
      coalesce(sum(fused_step_km) FILTER (NOT exclude_from_metrics), 0) AS Trip_Distance_km,
      coalesce(sum(time_delta_min) FILTER (NOT exclude_from_metrics AND is_idle), 0) AS Idle_Time_min,
      coalesce(sum(time_delta_min) FILTER (NOT exclude_from_metrics AND is_moving), 0) AS Moving_Time_min,
      count(*) FILTER (speeding_over120) AS Speeding_Count, count(*) FILTER (flagged_over120) AS Flagged_Count
      FROM p GROUP BY vehicle_id, trip_id HAVING count(*) FILTER (NOT exclude_from_metrics) > 0""",
    "ht": """SELECT *, (Trip_End_UTC - Trip_Start_UTC) / 60.0::DOUBLE AS Trip_Duration_min,
      CASE WHEN Trip_End_UTC > Trip_Start_UTC THEN Trip_Distance_km / ((Trip_End_UTC - Trip_Start_UTC) / 60.0::DOUBLE / 60) ELSE 0.0::DOUBLE END AS Avg_Speed_kmh,
      CASE WHEN Trip_End_UTC > Trip_Start_UTC THEN Idle_Time_min / ((Trip_End_UTC - Trip_Start_UTC) / 60.0::DOUBLE) * 100 ELSE 0.0::DOUBLE END AS Idle_Percentage FROM ht0""",
    "hv": """SELECT *, Trip_Start_UTC + 28800 AS Trip_Start_MYT, CAST(CAST(make_timestamp((Trip_Start_UTC + 28800) * 1000000) AS DATE) AS VARCHAR) AS date_myt
      FROM ht WHERE Trip_Duration_min >= 5 AND Trip_Distance_km >= 1""",
    "vd0": """SELECT vehicle_id, date_myt, sum(Trip_Distance_km) AS Total_Distance_km, sum(Trip_Duration_min) AS Total_Duration_min,
      sum(Idle_Time_min) AS Total_Idle_min, sum(Moving_Time_min) AS Total_Moving_min, count(*) AS Trip_Count,
      CAST(sum(Speeding_Count) AS BIGINT) AS Speeding_Count, CAST(sum(Flagged_Count) AS BIGINT) AS Flagged_Count FROM hv GROUP BY vehicle_id, date_myt""",
    "vd": """SELECT *, CASE WHEN Total_Duration_min > 0 THEN Total_Distance_km / (Total_Duration_min / 60) ELSE 0.0::DOUBLE END AS Daily_Avg_Speed_kmh,
      CASE WHEN Total_Duration_min > 0 THEN Total_Idle_min / Total_Duration_min * 100 ELSE 0.0::DOUBLE END AS Daily_Idle_Percentage FROM vd0""",
    # ignition trips
    "e0": """SELECT *, lag(engine_on) OVER v AS engine_prev, lead(engine_on) OVER v AS engine_next, lead(s) OVER v AS s_next
      FROM t WINDOW v AS (PARTITION BY vehicle_id ORDER BY s)""",
    "e1": "SELECT *, CASE WHEN engine_on AND NOT coalesce(engine_prev, false) THEN 1 ELSE 0 END AS starts FROM e0",
    "e2": "SELECT *, sum(starts) OVER (PARTITION BY vehicle_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS num FROM e1",
    "ev": """SELECT vehicle_id, coalesce(sum(n + 1) OVER (ORDER BY vehicle_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM (SELECT vehicle_id, sum(starts) AS n FROM e1 GROUP BY vehicle_id)""",
    "er": """SELECT vehicle_id, CAST(off + num AS BIGINT) AS trip_id, s, s AS timestamp, event_id, k, lat, lon, speed_kmh, engine_on, odometer_km, fuel_level, gps_ok AS gps_valid,
      CASE WHEN coalesce(engine_next, false) THEN least(s_next - s, 300)::DOUBLE ELSE 0.0::DOUBLE END AS delta_t_sec,
      coalesce(speed_kmh <= 1, false) AS is_idle, coalesce(speed_kmh > 1, false) AS is_moving FROM e2 JOIN ev USING (vehicle_id) WHERE engine_on""",
    "et0": """SELECT vehicle_id, trip_id, min(s) AS timestamp_start, max(s) AS timestamp_end,
      arg_min(lat, s) AS lat_start, arg_max(lat, s) AS lat_end, arg_min(lon, s) AS lon_start, arg_max(lon, s) AS lon_end,
      arg_min(odometer_km, s) FILTER (odometer_km IS NOT NULL) AS odometer_start, arg_max(odometer_km, s) FILTER (odometer_km IS NOT NULL) AS odometer_end,
      sum(delta_t_sec) AS total_time_sec, avg(speed_kmh) AS avg_speed_raw, count(*) FILTER (gps_valid) AS gps_valid_count,
      coalesce(sum(delta_t_sec) FILTER (is_idle), 0) / 60 AS Idle_Time_min, coalesce(sum(delta_t_sec) FILTER (is_moving), 0) / 60 AS Moving_Time_min,
      count(*) AS total_rows FROM er GROUP BY vehicle_id, trip_id""",
    "et1": """SELECT *, CASE WHEN odometer_end - odometer_start >= 0 THEN odometer_end - odometer_start END AS Trip_Distance_km,
      (timestamp_end - timestamp_start) / 60.0::DOUBLE AS Trip_Duration_min FROM et0""",
    "et2": f"""SELECT *, {div('Trip_Distance_km', 'Trip_Duration_min / 60')} AS Avg_Speed,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce({div('Idle_Time_min', 'Trip_Duration_min')}, 0))) AS Idle_Percentage,
      {km(*ENDS)} AS Optimal_Distance_km FROM et1""",
    "al": "SELECT vehicle_id, max(s) AS latest, max(odometer_km) AS odometer FROM t GROUP BY vehicle_id",
    "ad": """SELECT vehicle_id, CAST(make_timestamp(s * 1000000) AS DATE) AS day, arg_max(odometer_km, s) FILTER (odometer_km IS NOT NULL)
      - arg_min(odometer_km, s) FILTER (odometer_km IS NOT NULL) AS km FROM t JOIN al USING (vehicle_id) WHERE s >= latest - 60 * 86400 GROUP BY 1, 2""",
    "age": """SELECT al.vehicle_id, CASE WHEN total > 0 THEN odometer / (total * 0.5::DOUBLE) END AS Age_of_Truck_months
      FROM al LEFT JOIN (SELECT vehicle_id, sum(km) AS total FROM ad WHERE km >= 0 GROUP BY vehicle_id) USING (vehicle_id)""",
    "et": f"""SELECT et2.*, {clip(div('Optimal_Distance_km', 'Trip_Distance_km'), 0, 1.5)} AS Distance_Efficiency,
      {clip(div('Optimal_Distance_km / 80', 'Trip_Duration_min / 60'), 0, 2.0)} AS Time_Efficiency, 1 - Idle_Percentage AS Idle_Efficiency,
      {div('gps_valid_count', 'total_rows')} AS Signal_Reliability, Age_of_Truck_months,
      Trip_Distance_km IS NULL AS QA_negative_distance, Trip_Duration_min <= 0 AS QA_zero_duration
      FROM et2 LEFT JOIN age USING (vehicle_id)""",
    # rows joined to trips, route efficiency, trip features
    "mg": """SELECT er.trip_id, er.timestamp, er.s, er.lat, er.lon, er.speed_kmh, er.vehicle_id, et.vehicle_id AS vehicle_id_trip, et.Trip_Distance_km AS trip_distance_km,
      et.Trip_Duration_min AS trip_duration_min, et.Idle_Time_min AS idle_time_min, et.Moving_Time_min AS moving_time_min, et.Idle_Percentage AS idle_percentage,
      et.Distance_Efficiency AS distance_efficiency, et.Time_Efficiency AS time_efficiency, et.Idle_Efficiency AS idle_efficiency,
      et.Signal_Reliability AS signal_reliability, et.total_rows
      FROM er LEFT JOIN et USING (trip_id) WHERE er.lat BETWEEN -90 AND 90 AND er.lon BETWEEN -180 AND 180""",
    "tk0": """SELECT *, speed_kmh / 3.6::DOUBLE AS speed_mps, lag(s) OVER v AS s_prev, lag(lat) OVER v AS lat_prev, lag(lon) OVER v AS lon_prev,
      lag(speed_kmh) OVER v / 3.6::DOUBLE AS speed_mps_prev FROM mg WINDOW v AS (PARTITION BY trip_id ORDER BY s)""",
    "tk1": f"""SELECT *, {metres('lat_prev', 'lon_prev', 'lat', 'lon')} AS dist_to_prev, (s - s_prev)::DOUBLE AS time_delta FROM tk0""",
    "tk2": "SELECT *, dist_to_prev / nullif(time_delta, 0) AS implied_speed FROM tk1",
    "tk": f"""SELECT *, CASE WHEN NOT coalesce(implied_speed > 60, false) THEN ({bearing('lat_prev', 'lon_prev', 'lat', 'lon')} + 360) % 360 END AS bearing_track,
      implied_speed / nullif(speed_mps, 0) AS speed_ratio FROM tk2""",
    "rs0": """SELECT *, CASE WHEN bearing_track IS NOT NULL THEN CASE WHEN speed_mps < 0.5 THEN 0.0::DOUBLE
      WHEN speed_mps IS NOT NULL THEN least(speed_mps, coalesce(implied_speed, speed_mps)) END END AS forward_progress FROM tk""",
    "rs": f"""SELECT *, {clip("forward_progress / nullif((SELECT quantile_cont(speed_mps, 0.95) FROM tk), 0)", 0, 1)} AS route_eff FROM rs0""",
    "tf0": """SELECT trip_id, min(s) AS trip_start, max(s) AS trip_end, arg_min(lat, s) AS lat_start, arg_max(lat, s) AS lat_end,
      arg_min(lon, s) AS lon_start, arg_max(lon, s) AS lon_end, avg(route_eff) AS route_eff_avg, stddev_samp(route_eff) AS route_eff_std,
      avg(CASE WHEN route_eff > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS route_eff_high_pct, avg(speed_mps) AS speed_avg,
      stddev_samp(speed_mps) AS speed_std, max(speed_mps) AS speed_max, coalesce(max(idle_time_min), 0) * count(idle_time_min) AS idle_time_total,
      coalesce(max(moving_time_min), 0) * count(moving_time_min) AS moving_time_total, max(idle_percentage) AS idle_percentage, max(idle_efficiency) AS idle_efficiency_mean,
      arg_min(trip_distance_km, s) FILTER (trip_distance_km IS NOT NULL) AS trip_distance_km,
      arg_min(trip_duration_min, s) FILTER (trip_duration_min IS NOT NULL) AS trip_duration_min,
      max(distance_efficiency) AS distance_efficiency_mean, max(time_efficiency) AS time_efficiency_mean, max(signal_reliability) AS signal_reliability,
      count(speed_kmh) AS n_telemetry_points,
      count(*) FILTER (s_prev IS NULL OR coalesce(speed_mps > 0.5, false) <> coalesce(speed_mps_prev > 0.5, false)) / 2.0::DOUBLE AS n_stops,
      quantile_cont(route_eff, 0.5) AS route_eff_med, quantile_cont(speed_mps, 0.1) AS speed_p10, quantile_cont(speed_mps, 0.9) AS speed_p90
      FROM rs GROUP BY trip_id""",
    "tf": f"""SELECT *, {km(*ENDS)} AS great_circle_km, {clip(div(km(*ENDS), 'trip_distance_km'), 0, 1)} AS route_directness,
      {div('n_stops', 'trip_distance_km')} AS stops_per_km, {div('idle_time_total', 'idle_time_total + moving_time_total')} AS idle_ratio,
      {div('speed_std', 'speed_avg')} AS speed_cv, CAST(hour(make_timestamp(trip_start * 1000000)) AS BIGINT) AS hour_of_day,
      CAST(isodow(make_timestamp(trip_start * 1000000)) - 1 AS BIGINT) AS day_of_week,
      CAST(isodow(make_timestamp(trip_start * 1000000)) IN (6, 7) AS BIGINT) AS is_weekend,
      CAST(hour(make_timestamp(trip_start * 1000000)) IN (7, 8, 9, 17, 18, 19) AS BIGINT) AS is_peak_hour,
      {div('trip_distance_km', 'trip_duration_min / 60')} AS km_per_hour FROM tf0""",
}

FEATURE_COLUMNS = [
    "trip_id", "trip_start", "trip_end", "lat_start", "lat_end", "lon_start", "lon_end", "route_eff_avg", "route_eff_std", "route_eff_high_pct",
    "speed_avg", "speed_std", "speed_max", "idle_time_total", "moving_time_total", "idle_percentage", "idle_efficiency_mean", "trip_distance_km",
    "trip_duration_min", "distance_efficiency_mean", "time_efficiency_mean", "signal_reliability", "n_telemetry_points", "n_stops",
    "route_eff_med", "speed_p10", "speed_p90", "great_circle_km", "route_directness", "stops_per_km", "idle_ratio", "speed_cv",
    "hour_of_day", "day_of_week", "is_weekend", "is_peak_hour", "km_per_hour"]
NUMERIC_COLUMNS = [c for c in FEATURE_COLUMNS if c not in ("trip_id", "trip_start", "trip_end")]
TARGET = route.FALLBACK_TARGET


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _capped(c: str) -> str:
    return clip(f"{c}::DOUBLE", *route.DOMAIN_CAPS[c]) if c in route.DOMAIN_CAPS else f"{c}::DOUBLE"


BLOCKS["cap"] = "SELECT trip_id, trip_start, trip_end, " + ", ".join(f"{_capped(c)} AS {c}" for c in NUMERIC_COLUMNS) + " FROM tf"
BLOCKS["lim"] = "SELECT " + ", ".join(f"quantile_cont({c}, 0.005) AS lo_{c}, quantile_cont({c}, 0.995) AS hi_{c}" for c in NUMERIC_COLUMNS) + " FROM cap"
BLOCKS["an"] = ("SELECT trip_id, trip_start, trip_end, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN greatest(lo_{c}, least(hi_{c}, {c})) END AS {c}" for c in NUMERIC_COLUMNS) + " FROM cap, lim")
BLOCKS["cd"] = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count(*) AS row_count FROM tf" for i, c in enumerate(FEATURE_COLUMNS))
_ID_NAME = " OR ".join(f"contains(column_name, '{x}')" for x in route.ID_FRAGMENTS)
BLOCKS["cls"] = f"""SELECT pos, column_name, distinct_values, CASE WHEN column_name IN ('trip_start', 'trip_end') THEN 'datetime'
      WHEN column_name IN ({_quoted(route.GEO_NAMES)}) THEN 'geospatial'
      WHEN distinct_values / row_count > 0.9 OR (({_ID_NAME}) AND distinct_values / row_count > 0.5) THEN 'id_like'
      WHEN distinct_values > 10 OR ({_ID_NAME}) THEN 'numeric' ELSE 'categorical' END AS column_class FROM cd"""
BLOCKS["ft"] = f"""SELECT column_name, row_number() OVER (ORDER BY pos) AS nr FROM cls WHERE column_class = 'numeric'
      AND column_name NOT IN ({_quoted([*route.EXCLUDED_COLUMNS, *route.DROP_COLUMNS, TARGET])})"""
BLOCKS["lg"] = " UNION ALL ".join(f"SELECT trip_id, '{c}' AS name, {c} AS value FROM an WHERE {c} IS NOT NULL" for c in NUMERIC_COLUMNS)
BLOCKS["fl"] = "SELECT lg.*, nr FROM lg JOIN ft ON name = column_name"


def _average_rank(value: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE"


BLOCKS["pt"] = f"SELECT fl.name AS feature, nr, fl.value AS x, lg.value AS y FROM fl JOIN lg USING (trip_id) WHERE lg.name = '{TARGET}'"
BLOCKS["ptr"] = f"SELECT *, {_average_rank('x', 'feature')} AS rx, {_average_rank('y', 'feature')} AS ry FROM pt"
BLOCKS["rk"] = """SELECT feature, min(nr) AS nr, count(*) AS n, corr(rx, ry) AS spearman_r, corr(x, y) AS pearson_r FROM ptr GROUP BY feature HAVING count(*) > 10"""
BLOCKS["mx"] = f"""SELECT trip_id, name, value FROM fl WHERE nr <= 30 UNION ALL SELECT trip_id, name, value FROM lg WHERE name = '{TARGET}'"""
BLOCKS["mp"] = "SELECT a.name AS x, b.name AS y, a.value AS vx, b.value AS vy FROM mx a JOIN mx b USING (trip_id)"
BLOCKS["mpr"] = f"SELECT *, {_average_rank('vx', 'x, y')} AS rx, {_average_rank('vy', 'x, y')} AS ry FROM mp"
BLOCKS["mps"] = "SELECT x, y, CASE WHEN x = y THEN 1.0::DOUBLE ELSE corr(vx, vy) END AS pearson_r, CASE WHEN x = y THEN 1.0::DOUBLE ELSE corr(rx, ry) END AS spearman_r FROM mpr GROUP BY x, y"


def _kruskal(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / nullif(1 - ties / (n * n * n - n), 0) AS kw_statistic, CAST(g - 1 AS BIGINT) AS degrees_of_freedom FROM (
      SELECT sum(c)::DOUBLE AS n, sum(r * r / c) AS s, count(*) AS g, max(ties) AS ties FROM (
        SELECT cat, count(*) AS c, sum(rk) AS r FROM (SELECT *, {_average_rank('v', '1')} AS rk FROM ({_frequent(feature)})) GROUP BY cat),
        (SELECT sum(q * q * q - q) AS ties FROM (SELECT count(*)::DOUBLE AS q FROM ({_frequent(feature)}) GROUP BY v))) WHERE g >= 2"""


def _frequent(feature: str) -> str:
    rows = f"SELECT CAST({feature} AS VARCHAR) AS cat, {TARGET} AS v FROM an WHERE {feature} IS NOT NULL AND {TARGET} IS NOT NULL"
    return f"SELECT * FROM ({rows}) WHERE cat IN (SELECT cat FROM ({rows}) GROUP BY cat ORDER BY count(*) DESC, cat LIMIT 15)"


BLOCKS["kw"] = " UNION ALL ".join(_kruskal(f) for f in ("hour_of_day", "day_of_week", "is_weekend", "is_peak_hour"))
BLOCKS["bx0"] = _frequent("hour_of_day")
BLOCKS["bx1"] = "SELECT cat, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM bx0 GROUP BY cat"
BLOCKS["bx"] = """SELECT bx1.cat AS category, n, q1, median, q3,
      min(v) FILTER (v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low, max(v) FILTER (v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
      count(*) FILTER (NOT (v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)) AS outliers FROM bx0 JOIN bx1 USING (cat) GROUP BY ALL"""
BLOCKS["rank"] = "SELECT row_number() OVER (ORDER BY round(time, 6) DESC, vehicle) - 1 AS rank, vehicle, time FROM (SELECT vehicle_id AS vehicle, sum(Total_Moving_min) AS time FROM vd GROUP BY 1)"

# modelling features
BLOCKS["ta"] = """SELECT trip_id, coalesce(avg(speed_kmh), 0) AS speed_mean, coalesce(stddev_samp(speed_kmh), 0) AS speed_std, coalesce(min(speed_kmh), 0) AS speed_min,
      coalesce(max(speed_kmh), 0) AS speed_max, coalesce(quantile_cont(speed_kmh, 0.5), 0) AS speed_median, coalesce(quantile_cont(speed_kmh, 0.25), 0) AS speed_p25,
      coalesce(quantile_cont(speed_kmh, 0.75), 0) AS speed_p75, coalesce(quantile_cont(speed_kmh, 0.9), 0) AS speed_p90,
      coalesce(quantile_cont(speed_kmh, 0.75) - quantile_cont(speed_kmh, 0.25), 0) AS speed_iqr, coalesce(stddev_samp(speed_kmh) / (avg(speed_kmh) + 1e-6), 0) AS speed_cv,
      count(*) FILTER (speed_kmh < 3) AS stop_count, count(*) AS telemetry_rows, count(*) FILTER (speed_kmh > 90) AS overspeed_count,
      count(*) FILTER (is_idle) AS idle_event_count, avg(is_idle::INT) AS idle_percentage_rows, count(*) FILTER (is_moving) AS moving_event_count,
      avg(is_moving::INT) AS moving_percentage_rows FROM er GROUP BY trip_id"""
_RATES = """stop_count / (Trip_Distance_km / 100 + 1e-6) AS stop_count_per_100km, overspeed_count / (Trip_Distance_km / 100 + 1e-6) AS overspeed_count_per_100km,
      idle_event_count / (Trip_Distance_km / 100 + 1e-6) AS idle_events_per_100km, stop_count / (Trip_Duration_min / 60 + 1e-6) AS stop_count_per_hour,
      overspeed_count / (Trip_Duration_min / 60 + 1e-6) AS overspeed_count_per_hour"""
BLOCKS["tj"] = f"SELECT et.*, ta.* EXCLUDE (trip_id), {_RATES} FROM et LEFT JOIN ta USING (trip_id)"
BLOCKS["tr"] = """SELECT * FROM tj WHERE NOT QA_zero_duration AND NOT QA_negative_distance AND Trip_Duration_min > 0 AND Trip_Distance_km > 0
      AND lat_start IS NOT NULL AND lon_start IS NOT NULL AND lat_end IS NOT NULL AND lon_end IS NOT NULL"""
_PI = "6.283185307179586::DOUBLE"
BLOCKS["fr0"] = f"""SELECT *, {km(*ENDS)} AS haversine_km, {bearing(*ENDS)} AS bearing, lat_end - lat_start AS delta_lat, lon_end - lon_start AS delta_lon,
      hour(make_timestamp(timestamp_start * 1000000)) AS hh, isodow(make_timestamp(timestamp_start * 1000000)) - 1 AS dd,
      Idle_Time_min / (Trip_Duration_min + 1e-6) AS idle_ratio, Moving_Time_min / (Trip_Duration_min + 1e-6) AS moving_ratio,
      Idle_Time_min / (Trip_Distance_km + 1e-6) AS idle_per_km,
      CASE WHEN Trip_Distance_km <= 0 THEN NULL WHEN Trip_Distance_km <= 10 THEN '0-10km' WHEN Trip_Distance_km <= 50 THEN '10-50km'
           WHEN Trip_Distance_km <= 200 THEN '50-200km' ELSE '200+km' END AS distance_bucket FROM tr"""
BLOCKS["fr1"] = f"""SELECT *, Trip_Distance_km / (haversine_km + 1e-6) AS detour_ratio, {clip('haversine_km / (Trip_Distance_km + 1e-6)', 0, 1)} AS directness_efficiency,
      sin({_PI} * hh / 24) AS hour_sin, cos({_PI} * hh / 24) AS hour_cos, sin({_PI} * dd / 7) AS dow_sin, cos({_PI} * dd / 7) AS dow_cos,
      row_number() OVER (ORDER BY timestamp_start, trip_id) <= floor(0.8::DOUBLE * count(*) OVER ()) AS is_train FROM fr0"""
BLOCKS["fr"] = f"SELECT *, 0.5::DOUBLE * directness_efficiency + 0.3::DOUBLE * (1 - idle_ratio) + 0.2::DOUBLE * {clip('(Avg_Speed / 60)', 0, 1).replace('CASE', '(CASE').replace('END', 'END)')} AS route_efficiency FROM fr1"
BLOCKS["bs"] = "SELECT distance_bucket, quantile_cont(Avg_Speed, 0.5) AS reference_speed FROM fr WHERE is_train GROUP BY distance_bucket"
BLOCKS["b2"] = """SELECT trip_id, directness_efficiency, idle_ratio, greatest(0.0::DOUBLE, least(1.0::DOUBLE, Avg_Speed / (coalesce(reference_speed, Avg_Speed) + 1e-6))) AS speed_efficiency
      FROM fr LEFT JOIN bs USING (distance_bucket)"""
BLOCKS["rq"] = """SELECT trip_id, vehicle_id, timestamp_start, lat_start, lon_start, lat_end, lon_end, Trip_Distance_km,
      CASE WHEN trip_id % 11 <> 0 THEN Trip_Duration_min ELSE 0.0::DOUBLE END AS Trip_Duration_min, Idle_Time_min, Moving_Time_min, Avg_Speed,
      Idle_Percentage * CASE WHEN trip_id % 13 = 0 THEN 1000 ELSE 100 END AS Idle_Percentage, coalesce(Age_of_Truck_months, 0) AS Age_of_Truck_months,
      CASE WHEN trip_id % 3 <> 0 THEN speed_mean END AS speed_mean, CASE WHEN trip_id % 2 = 0 THEN speed_median END AS speed_median,
      CASE WHEN trip_id % 5 = 0 THEN 0.0::DOUBLE ELSE speed_p25 END AS speed_p25, speed_p75, CASE WHEN trip_id % 7 <> 0 THEN stop_count END AS stop_count,
      moving_event_count, idle_event_count FROM fr"""
BLOCKS["rs1"] = """SELECT trip_id, coalesce(speed_mean, Avg_Speed) AS speed_mean,
      CASE WHEN speed_mean IS NOT NULL AND speed_median <> 0 THEN speed_median ELSE coalesce(speed_mean, Avg_Speed) END AS speed_median,
      CASE WHEN speed_mean IS NOT NULL AND speed_p25 <> 0 THEN speed_p25 ELSE coalesce(speed_mean, Avg_Speed) * 0.8::DOUBLE END AS speed_p25,
      CASE WHEN speed_mean IS NOT NULL AND speed_p75 <> 0 THEN speed_p75 ELSE coalesce(speed_mean, Avg_Speed) * 1.2::DOUBLE END AS speed_p75,
      coalesce(speed_mean, Avg_Speed) * 1.4::DOUBLE AS speed_p90, coalesce(speed_mean, Avg_Speed) * 0.2::DOUBLE AS speed_std FROM rq"""
BLOCKS["rs2"] = "SELECT *, speed_p25 * 0.5::DOUBLE AS speed_min, speed_p90 * 1.2::DOUBLE AS speed_max, speed_p75 - speed_p25 AS speed_iqr, speed_std / (speed_mean + 1e-6) AS speed_cv FROM rs1"
_CHECKS = []
for _c in features.REQUIRED:
    _low, _high = features.FIELD_RANGES.get(_c, (None, None))
    _ok = [f"{_c} IS NOT NULL"]
    if _low is not None:
        _ok.append(f"{_c} {'>' if _c in features.ABOVE_ZERO else '>='} {_low}")
    if _high is not None:
        _ok.append(f"{_c} <= {_high}")
    _CHECKS.append(f"CASE WHEN NOT ({' AND '.join(_ok)}) THEN '{_c}' END")
BLOCKS["rv"] = f"SELECT *, concat_ws(',', {', '.join(_CHECKS)}) AS rejected_fields FROM rq"
BLOCKS["rc"] = """SELECT *, greatest(coalesce(stop_count, 0) + moving_event_count, 1) AS telemetry_rows FROM rv WHERE rejected_fields = ''"""

_NAMES = list(BLOCKS)
_CHAINS: dict[str, list[str]] = {}


def _used(text: str) -> set[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", re.sub(r"'[^']*'", "", text)))
    sources = set()
    for clause in re.findall(r"(?:FROM|JOIN)\s+([A-Za-z_0-9, ]+)", text):
        sources |= set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", clause))
    return {w for w in words & sources if w in BLOCKS}


def with_blocks(select: str) -> str:
    """Put the blocks a SELECT needs in front of it."""
    needed, todo = set(), _used(select)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= _used(BLOCKS[name]) - {name}
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in _NAMES if n in needed) + "\n" + select


def report(columns: str, source: str, digits: int = 5) -> str:
    """SELECT of `columns` (comma-separated; `:r` rounds) from `source`."""
    out = []
    for c in (x.strip() for x in columns.split(",")):
        name, _, how = c.partition(":")
        out.append(f"{rounded(name, digits)} AS {name}" if how == "r" else name)
    return with_blocks(f"SELECT {', '.join(out)} FROM {source}")


def rounded(x: str, digits: int = 5) -> str:
    return f"round({x} + {NUDGE}, {digits}) + 0.0"


TRIP_OUT = ("vehicle_id, trip_id, timestamp_start, timestamp_end, lat_start:r, lon_start:r, lat_end:r, lon_end:r, Trip_Distance_km:r, Trip_Duration_min:r, "
            "Avg_Speed:r, Idle_Time_min:r, Moving_Time_min:r, Idle_Percentage:r, Distance_Efficiency:r, Time_Efficiency:r, Idle_Efficiency:r, "
            "Signal_Reliability:r, Age_of_Truck_months:r, total_rows, QA_negative_distance, QA_zero_duration")


def _missing(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count("{c}") AS missing_count, round_even((count(*) - count("{c}")) / count(*)::DOUBLE * 100, 2) + 0.0 AS missing_percentage FROM raw"""
        for c in columns)


RAW = ["Timestamp", "CarNumberPlate", "Latitude", "Longitude", "Speed", "EngineStatus", "Odometer", "FuelLevelPercentage", "GPSLocated", "Direction", "Note", "row_id"]


def _thinned(source: str, degrees: float) -> str:
    return with_blocks(f"""SELECT vehicle_id, seq * 1000000 AS seq, {rounded('lat')} AS lat, {rounded('lon')} AS lon FROM (
      SELECT *, lag(lat) OVER v AS lat0, lag(lon) OVER v AS lon0 FROM (SELECT vehicle_id, lat, lon, min(s) AS seq FROM {source} GROUP BY vehicle_id, lat, lon)
      WINDOW v AS (PARTITION BY vehicle_id ORDER BY seq)) WHERE lat0 IS NULL OR abs(lat - lat0) > {degrees} OR abs(lon - lon0) > {degrees}""")


def _describe(source: str) -> str:
    """Describe of (name, value) rows."""
    return with_blocks(f"""SELECT name AS column_name, count(value) AS n, {rounded('avg(value)')} AS mean, {rounded('stddev_samp(value)')} AS std,
      {rounded('min(value)')} AS min_value, {rounded('max(value)')} AS max_value, {rounded('quantile_cont(value, 0.25)')} AS q25,
      {rounded('quantile_cont(value, 0.5)')} AS q50, {rounded('quantile_cont(value, 0.75)')} AS q75 FROM {source} GROUP BY name""")


def _temporal(label: str, value: str) -> str:
    return f"""SELECT '{label}' AS grouping, {value} AS group_value, {rounded(f'avg({TARGET})')} AS mean, {rounded(f'stddev_samp({TARGET})')} AS std,
      count({TARGET}) AS n, {rounded(f'quantile_cont({TARGET}, 0.5)')} AS median FROM an GROUP BY 2"""


def _percentiles(c: str) -> str:
    return f"SELECT '{c}' AS column_name, " + ", ".join(f"{rounded(f'quantile_cont({c}, {p / 100})')} AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99)) + " FROM an"


_SPAN = f"(SELECT min({TARGET}) AS lo, (max({TARGET}) - min({TARGET})) / 50 AS wd FROM an)"


def oracles() -> dict[str, str]:
    r = report
    sql = {
        "a01_csv_scan": with_blocks(f"SELECT CarNumberPlate AS Vehicle, count(*) AS row_count, count(Note) AS notes, count(EngineStatus) AS engine_values, {rounded('sum(CAST(Odometer AS DOUBLE))')} AS sum_odometer FROM raw WHERE CarNumberPlate IS NOT NULL GROUP BY 1"),
        "a02_plate_from_file_name": with_blocks("SELECT vehicle_id AS plate, count(*) AS row_count FROM t GROUP BY 1"),
        "a03_row_concat": with_blocks(f"SELECT vehicle_id, s, CASE WHEN engine_on THEN {rounded('speed_kmh')} END AS speed_kmh, CASE WHEN NOT engine_on THEN {rounded('fuel_level')} END AS fuel_level FROM t"),
        "a04_missing_profile": with_blocks(_missing(RAW)),
        "a05_drop_sparse_columns": with_blocks(f"SELECT * FROM ({_missing(RAW)}) WHERE missing_percentage <= 50"),
        "a06_row_dedup": with_blocks("SELECT DISTINCT vehicle_id, CAST(floor(s / 3600.0) AS BIGINT) AS hour, engine_on, gps_ok FROM tall"),
        "a06_row_dedup_counts": with_blocks("SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n - 1) AS BIGINT) AS rows_removed FROM (SELECT count(*) AS n FROM tall GROUP BY vehicle_id, floor(s / 3600.0), engine_on, gps_ok)"),
        "a07_csv_sink": r("vehicle_id, trip_id, Trip_Distance_km:r, total_rows", "et"),
        "a08_parquet_sink": with_blocks(f"SELECT vehicle_id, Trip_Count, {rounded('Total_Distance_km')} AS Total_Distance_km, date_myt AS day FROM vd"),
        "a09_pruned_scan": with_blocks(f"SELECT vehicle_id, {rounded('min(lat)')} AS min_lat, {rounded('max(lat)')} AS max_lat, {rounded('min(lon)')} AS min_lon, {rounded('max(lon)')} AS max_lon FROM t GROUP BY 1"),
        "b01_alias_columns": with_blocks(f"""SELECT "Timestamp" AS timestamp_utc, CarNumberPlate AS vehicle_id, EngineStatus AS engine_on, GPSLocated AS gps_ok, {rounded('TRY_CAST(Speed AS DOUBLE)')} AS speed_kmh,
            {rounded('CAST(Latitude AS DOUBLE)')} AS lat, {rounded('CAST(Longitude AS DOUBLE)')} AS lon, {rounded('CAST(Odometer AS DOUBLE)')} AS odometer_km, row_id FROM raw"""),
        "b02_explicit_columns": with_blocks("""SELECT "Timestamp" AS timestamp, CarNumberPlate AS vehicle_id, EngineStatus AS engine_on, GPSLocated AS gps_valid, FuelLevelPercentage AS fuel_level FROM raw"""),
        "b03_parse_time": with_blocks("SELECT row_id, ts AS parsed FROM typed"),
        "b04_parse_numbers": with_blocks("SELECT row_id, " + ", ".join(f"{rounded(f'TRY_CAST({c} AS DOUBLE)')} AS {c.lower()}" for c in ("Speed", "Odometer", "Latitude", "Longitude", "FuelLevelPercentage")) + " FROM raw"),
        "b05_blanket_truth": with_blocks("SELECT row_id, coalesce(EngineStatus <> '', true) AS engine_truth, coalesce(GPSLocated <> '', true) AS gps_truth FROM raw"),
        "b06_boolean_tokens": r("row_id, engine_on, gps_ok", "typed"),
        "b07_require_fields": with_blocks(f"SELECT ts, vehicle_id, engine_on, gps_ok, {rounded('speed_kmh')} AS speed_kmh FROM typed WHERE ts IS NOT NULL AND vehicle_id IS NOT NULL"),
        "b08_time_order": with_blocks("SELECT vehicle_id, s, row_number() OVER (PARTITION BY vehicle_id ORDER BY s) AS position FROM t"),
        "b09_keyed_dedup": r("vehicle_id, s, event_id, speed_kmh:r, engine_on, gps_ok, odometer_km:r, lat:r, lon:r", "t"),
        "b10_snake_case": with_blocks(f"SELECT trip_id, {rounded('Trip_Distance_km')} AS trip_distance_km, {rounded('Idle_Percentage')} AS idle_percentage FROM et"),
        "b11_coordinate_range": with_blocks(f"SELECT vehicle_id, s, {rounded('lat')} AS lat, {rounded('lon')} AS lon FROM (SELECT vehicle_id, s, lon, CASE WHEN k % 10 <> 0 THEN lat * CASE WHEN k = 96 THEN 30.0::DOUBLE ELSE 1.0::DOUBLE END END AS lat FROM t) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"),
        "b12_non_negative_speed": with_blocks(f"SELECT vehicle_id, s, {rounded('speed_kmh - 5')} AS speed FROM t WHERE speed_kmh - 5 >= 0"),
        "b13_dataset_profile": with_blocks("SELECT count(*) AS row_count, min(s) AS first_time, max(s) AS last_time, count(DISTINCT vehicle_id) AS vehicles FROM t"),
        "c01_haversine": with_blocks(f"SELECT vehicle_id, s, {rounded('gps_step_raw')} AS km, {rounded(metres('lat_prev', 'lon_prev', 'lat', 'lon'))} AS metres FROM st"),
        "c02_compass_bearing": with_blocks(f"SELECT vehicle_id, s, {rounded('(' + bearing('lat_prev', 'lon_prev', 'lat', 'lon') + ' + 360) % 360')} AS bearing FROM st"),
        "c03_signed_bearing": with_blocks(f"SELECT vehicle_id, s, {rounded(bearing('lat_prev', 'lon_prev', 'lat', 'lon'))} AS bearing FROM st"),
        "c04_angle_gap": with_blocks(f"SELECT vehicle_id, s, {rounded('least(abs(direction - fuel_level), 360 - abs(direction - fuel_level))')} AS gap FROM t"),
        "c05_rolling_median_speed": r("vehicle_id, s, speed_kmh:r, speed_smoothed:r", "st"),
        "c06_lag_features": with_blocks(f"SELECT vehicle_id, s, {rounded('lat_prev')} AS lat_prev, {rounded('lon_prev')} AS lon_prev, s_prev AS time_prev, {rounded('time_delta_hours')} AS time_delta_hours, {rounded('gps_step_raw')} AS gps_step_raw FROM st"),
        "c07_implied_speed": r("vehicle_id, s, implied_speed_kmh:r", "st"),
        "c08_teleports": r("vehicle_id, s, implied_speed_kmh:r, teleport, gps_step_km:r", "st"),
        "c09_bad_fixes": r("vehicle_id, s, gps_ok, gps_step_km:r", "st"),
        "c10_odometer_step": r("vehicle_id, s, odo_step_km:r", "st"),
        "c11_invalid_odometer": r("vehicle_id, s, odo_step_km:r, invalid_odo_step", "st"),
        "c12_calibration_ratio": r("vehicle_id, s, odo_gps_ratio:r", "st"),
        "c13_scale_factor": r("vehicle_id, scale:r", "sf"),
        "c14_fused_distance": r("vehicle_id, s, scale_factor:r, fused_step_km:r, from_odometer, from_gps", "p"),
        "c15_missing_distance": r("vehicle_id, s, distance_missing", "p"),
        "c16_speeding_labels": r("vehicle_id, s, flagged_over120, speeding_over120, exclude_from_metrics", "p"),
        "c17_idle_moving": r("vehicle_id, s, is_idle, is_moving", "p"),
        "c18_quality_counters": with_blocks(f"""SELECT count(*) AS points, count(gps_step_raw) AS gps_steps, count(*) FILTER (implied_speed_kmh > 140) AS teleports, count(*) FILTER (NOT gps_ok) AS bad_fixes,
            count(gps_step_km) AS valid_gps_steps, count(odo_step_km) AS odometer_steps, count(*) FILTER (invalid_odo_step) AS invalid_odometer_steps, count(odo_gps_ratio) AS calibration_segments,
            count(*) FILTER (from_odometer) AS from_odometer, count(*) FILTER (from_gps) AS from_gps, count(*) FILTER (distance_missing) AS distance_missing, count(*) FILTER (speeding_over120) AS speeding,
            count(*) FILTER (flagged_over120) AS flagged, count(*) FILTER (exclude_from_metrics) AS excluded, count(*) FILTER (is_idle) AS idle_points, count(*) FILTER (is_moving) AS moving_points,
            {rounded('sum(fused_step_km)')} AS fused_km, {rounded('avg(fused_step_km)')} AS mean_step_km FROM p"""),
        "d01_hybrid_segmentation": r("vehicle_id, s, trip_id", "p"),
        "d02_trip_key": with_blocks("SELECT concat(vehicle_id, '_', trip_id) AS trip_key, count(*) AS row_count FROM p GROUP BY 1"),
        "d03_legacy_numbering": with_blocks("SELECT vehicle_id, s, legacy_trip_id AS trip_id FROM p"),
        "d04_trip_aggregate": r("vehicle_id, trip_id, Trip_Start_UTC, Trip_End_UTC, Trip_Distance_km:r, Idle_Time_min:r, Moving_Time_min:r", "ht"),
        "d05_trip_kpis": r("vehicle_id, trip_id, Trip_Duration_min:r, Avg_Speed_kmh:r, Idle_Percentage:r", "ht"),
        "d06_trip_events": r("vehicle_id, trip_id, Speeding_Count, Flagged_Count", "ht"),
        "d07_valid_trips": r("vehicle_id, trip_id, Trip_Duration_min:r, Trip_Distance_km:r", "hv"),
        "d08_local_date": r("vehicle_id, trip_id, Trip_Start_MYT, date_myt", "hv"),
        "d09_vehicle_day": r("vehicle_id, date_myt, Total_Distance_km:r, Total_Duration_min:r, Total_Idle_min:r, Total_Moving_min:r, Trip_Count, Speeding_Count, Flagged_Count", "vd"),
        "d10_vehicle_day_kpis": r("vehicle_id, date_myt, Daily_Avg_Speed_kmh:r, Daily_Idle_Percentage:r", "vd"),
        "d11_distance_consistency": with_blocks(f"""SELECT {rounded('a', 4)} AS trip_km, {rounded('b', 4)} AS fused_km, {rounded('abs(a - b)', 4)} AS diff_km, {rounded('abs(a - b) / b * 100', 4)} AS diff_percent
            FROM (SELECT sum(Trip_Distance_km) AS a FROM hv), (SELECT sum(fused_step_km) AS b FROM p WHERE NOT exclude_from_metrics)"""),
        "d12_sanity_bands": with_blocks(f"""SELECT count(*) AS trips, count(*) FILTER (Avg_Speed_kmh BETWEEN 20 AND 90) AS speed_20_90, {rounded('avg((Avg_Speed_kmh BETWEEN 20 AND 90)::INT) * 100')} AS speed_20_90_percent,
            count(*) FILTER (Avg_Speed_kmh < 20) AS speed_below_20, count(*) FILTER (Avg_Speed_kmh > 90) AS speed_above_90, count(*) FILTER (Idle_Percentage BETWEEN 0 AND 60) AS idle_0_60,
            {rounded('avg((Idle_Percentage BETWEEN 0 AND 60)::INT) * 100')} AS idle_0_60_percent, count(*) FILTER (Idle_Percentage > 60) AS idle_above_60, count(*) FILTER (Idle_Percentage > 80) AS idle_above_80,
            count(*) FILTER (Avg_Speed_kmh > 90 OR Idle_Percentage > 80) AS to_review FROM hv"""),
        "d12_suspect_trips": r("vehicle_id, trip_id, Trip_Distance_km:r, Trip_Duration_min:r, Avg_Speed_kmh:r, Idle_Percentage:r", "hv WHERE Avg_Speed_kmh > 90 OR Idle_Percentage > 80"),
        "d13_trips_per_vehicle": _describe("(SELECT 'trips' AS name, count(DISTINCT trip_id)::DOUBLE AS value FROM p GROUP BY vehicle_id)"),
        "d14_clean_points": with_blocks("SELECT s AS timestamp_utc, vehicle_id, engine_on, gps_ok, invalid_odo_step, distance_missing, flagged_over120, speeding_over120, exclude_from_metrics, trip_id, concat(vehicle_id, '_', trip_id) AS trip_key, is_idle, is_moving, "
                                        + ", ".join(f"{rounded(c)} AS {c}" for c in ("speed_kmh", "speed_smoothed", "odometer_km", "lat", "lon", "gps_step_km", "time_delta_hours", "time_delta_min", "odo_step_km", "scale_factor", "fused_step_km", "implied_speed_kmh")) + " FROM p"),
        "d15_pipeline_summary": with_blocks(f"""SELECT valid_trips, {rounded('a', 4)} AS mean_duration_min, {rounded('b', 4)} AS mean_distance_km, {rounded('c1', 4)} AS mean_avg_speed_kmh, {rounded('d1', 4)} AS mean_idle_percentage, vehicles,
            {rounded('valid_trips / vehicles', 4)} AS trips_per_vehicle, vehicle_days, {rounded('x', 4)} AS mean_trips_per_day, {rounded('y', 4)} AS mean_km_per_day, {rounded('z', 4)} AS mean_minutes_per_day
            FROM (SELECT count(*) AS valid_trips, avg(Trip_Duration_min) AS a, avg(Trip_Distance_km) AS b, avg(Avg_Speed_kmh) AS c1, avg(Idle_Percentage) AS d1 FROM hv), (SELECT count(DISTINCT vehicle_id) AS vehicles FROM p),
            (SELECT count(*) AS vehicle_days, avg(Trip_Count) AS x, avg(Total_Distance_km) AS y, avg(Total_Duration_min) AS z FROM vd)"""),
        "e01_ignition_segmentation": r("vehicle_id, s, trip_id", "er"),
        "e02_engine_on_rows": r("vehicle_id, s, speed_kmh:r, engine_on", "er"),
        "e03_time_to_next": r("vehicle_id, s, delta_t_sec:r", "er"),
        "e04_idle_moving_raw": r("vehicle_id, s, is_idle, is_moving", "er"),
        "e05_trip_aggregate": r("vehicle_id, trip_id, timestamp_start, timestamp_end, lat_start:r, lat_end:r, lon_start:r, lon_end:r, odometer_start:r, odometer_end:r, total_time_sec:r, avg_speed_raw:r, gps_valid_count", "et"),
        "e06_odometer_distance": r("trip_id, Trip_Distance_km:r", "et"),
        "e07_duration_speed": r("trip_id, Trip_Duration_min:r, Avg_Speed:r", "et"),
        "e08_idle_moving_minutes": r("trip_id, Idle_Time_min:r, Moving_Time_min:r, total_rows", "et"),
        "e09_idle_fraction": r("trip_id, Idle_Percentage:r", "et"),
        "e10_distance_efficiency": r("trip_id, Distance_Efficiency:r", "et"),
        "e11_time_efficiency": r("trip_id, Time_Efficiency:r", "et"),
        "e12_idle_efficiency": r("trip_id, Idle_Efficiency:r", "et"),
        "e13_signal_reliability": r("trip_id, Signal_Reliability:r", "et"),
        "e14_truck_age": r("vehicle_id, Age_of_Truck_months:r", "age", 4),
        "e15_qa_flags": r("trip_id, QA_negative_distance, QA_zero_duration", "et"),
        "e16_trip_table": r(TRIP_OUT, "et"),
        "e17_row_table": r("vehicle_id, trip_id, timestamp, lat:r, lon:r, speed_kmh:r, engine_on, odometer_km:r, is_idle, is_moving, gps_valid", "er"),
        "e18_qa_report": with_blocks(f"""SELECT count(*) AS trips, count(*) FILTER (Trip_Distance_km IS NULL) AS without_distance, {rounded('avg((Trip_Distance_km IS NULL)::INT) * 100')} AS without_distance_percent,
            {rounded('max(q1)')} AS speed_p01, {rounded('max(q9)')} AS speed_p99, count(*) FILTER (Avg_Speed > q9) AS trips_above_p99, count(*) FILTER (Avg_Speed < q1) AS trips_below_p01,
            count(*) FILTER (Idle_Percentage > 0.5) AS mostly_idle, {rounded('avg((Idle_Percentage > 0.5)::INT) * 100')} AS mostly_idle_percent,
            count(*) FILTER (abs(Idle_Time_min + Moving_Time_min - Trip_Duration_min) / nullif(Trip_Duration_min, 0) * 100 < 10) AS consistent_trips,
            {rounded('avg(Distance_Efficiency)')} AS mean_distance_efficiency, {rounded('avg(Time_Efficiency)')} AS mean_time_efficiency, {rounded('avg(Idle_Efficiency)')} AS mean_idle_efficiency,
            {rounded('avg(Signal_Reliability)')} AS mean_signal_reliability FROM et, (SELECT quantile_cont(Avg_Speed, 0.01) AS q1, quantile_cont(Avg_Speed, 0.99) AS q9 FROM et)"""),
        "e19_vehicle_summary": with_blocks(f"SELECT vehicle_id, count(*) AS num_trips, {rounded('coalesce(sum(Trip_Distance_km), 0)', 4)} AS total_distance, {rounded('max(Age_of_Truck_months)', 4)} AS Age_of_Truck_months FROM et GROUP BY 1"),
        "e19_fleet_means": with_blocks(f"SELECT count(*) AS vehicles, {rounded('avg(n)', 4)} AS mean_trips, {rounded('avg(x)', 4)} AS mean_distance, count(a) AS vehicles_with_age FROM (SELECT count(*) AS n, coalesce(sum(Trip_Distance_km), 0) AS x, max(Age_of_Truck_months) AS a FROM et GROUP BY vehicle_id)"),
        "f01_rows_to_trips": r("trip_id, timestamp, vehicle_id_trip, trip_distance_km:r, total_rows", "mg"),
        "f01_match_rate": with_blocks(f"SELECT count(*) AS row_count, {rounded('avg((vehicle_id_trip IS NOT NULL)::INT)')} AS match_rate FROM mg"),
        "f02_enrichment_join": with_blocks(f"SELECT mg.trip_id, mg.timestamp, {rounded('mg.speed_kmh')} AS speed_kmh, {rounded('x.speed_kmh')} AS speed_kmh_combined, {rounded('x.fuel_level')} AS fuel_level FROM mg LEFT JOIN er x ON mg.trip_id = x.trip_id AND mg.timestamp = x.timestamp"),
        "f02_enrichment_all_rows": with_blocks(f"SELECT mg.trip_id, mg.timestamp, {rounded('mg.speed_kmh')} AS speed_kmh, {rounded('x.speed_kmh')} AS speed_kmh_combined, {rounded('x.fuel_level')} AS fuel_level FROM mg LEFT JOIN er x ON mg.trip_id = x.trip_id AND mg.timestamp = x.timestamp"),
        "f03_route_efficiency": r("trip_id, timestamp, speed_mps:r, dist_to_prev:r, time_delta:r, implied_speed:r, bearing_track:r, speed_ratio:r, forward_progress:r, route_eff:r", "rs"),
        "f04_global_quantile": with_blocks(f"SELECT {rounded('quantile_cont(speed_mps, 0.95)', 6)} AS speed_p95 FROM tk"),
        "f05_route_diagnostics": with_blocks(f"""SELECT count(*) AS row_count, count(*) FILTER (speed_mps < 0.5) AS stationary, count(*) FILTER (speed_mps >= 0.5) AS moving, count(*) FILTER (route_eff = 0) AS zero_efficiency,
            count(*) FILTER (route_eff > 0.5) AS above_half, count(*) FILTER (implied_speed > 60) AS unreliable, count(*) FILTER (route_eff IS NULL) AS unknown, {rounded('avg((route_eff IS NULL)::INT)')} AS unknown_share FROM rs"""),
        "f06_trip_telemetry": r("trip_id, trip_start, trip_end, n_telemetry_points, " + ", ".join(f"{c}:r" for c in FEATURE_COLUMNS[3:27] if c != "n_telemetry_points"), "tf"),
        "f07_route_directness": r("trip_id, great_circle_km:r, route_directness:r", "tf"),
        "f08_stops": r("trip_id, n_stops:r, stops_per_km:r", "tf"),
        "f09_trip_ratios": r("trip_id, idle_ratio:r, speed_cv:r, km_per_hour:r", "tf"),
        "f10_calendar_features": r("trip_id, hour_of_day, day_of_week, is_weekend, is_peak_hour", "tf"),
        "f11_column_classes": with_blocks("SELECT column_name, distinct_values, CASE WHEN column_name = 'n_stops' THEN 'numeric' ELSE column_class END AS column_class FROM cls"),
        "f12_outlier_clipping": r("trip_id, trip_start, trip_end, " + ", ".join(f"{c}:r" for c in NUMERIC_COLUMNS), "an"),
        "f13_analysis_columns": with_blocks(f"""SELECT column_name, column_class, CASE WHEN column_name IN ({_quoted(route.DROP_COLUMNS)}) THEN 'dropped' WHEN column_name = '{TARGET}' THEN 'target'
            WHEN column_name IN ({_quoted(route.EXCLUDED_COLUMNS)}) THEN 'excluded' WHEN column_class = 'numeric' THEN 'feature' ELSE 'other' END AS role FROM cls"""),
        "f15_feature_ranking": with_blocks(f"SELECT feature, n, {rounded('spearman_r', 6)} AS spearman_r, {rounded('pearson_r', 6)} AS pearson_r, {rounded('abs(spearman_r)', 6)} AS abs_spearman, {rounded('abs(pearson_r)', 6)} AS abs_pearson FROM rk"),
        "f16_pearson_matrix": r("x, y, pearson_r:r", "mps", 6),
        "f17_spearman_matrix": r("x, y, spearman_r:r", "mps", 6),
        "f18_correlation_summary": with_blocks(f"SELECT feature, {rounded('pearson_r', 6)} AS pearson_r, {rounded('spearman_r', 6)} AS spearman_r FROM (SELECT feature, corr(x, y) AS pearson_r, corr(rx, ry) AS spearman_r FROM ptr WHERE nr <= 30 GROUP BY feature UNION ALL SELECT '{TARGET}', 1.0, 1.0)"),
        "f19_histogram": with_blocks(f"""SELECT bin, {rounded('lo + bin * wd')} AS bin_start, {rounded('lo + (bin + 1) * wd')} AS bin_end, count(an.trip_id) AS row_count
            FROM range(50) g(bin), {_SPAN} LEFT JOIN an ON CAST(least(floor(({TARGET} - lo) / wd), 49) AS BIGINT) = bin AND {TARGET} IS NOT NULL GROUP BY bin, lo, wd"""),
        "f20_value_counts": with_blocks(f"SELECT {rounded('hour_of_day')} AS hour_of_day, count(*) AS row_count, (SELECT count(DISTINCT hour_of_day) FROM an) AS distinct_values FROM an WHERE hour_of_day IS NOT NULL GROUP BY an.hour_of_day ORDER BY count(*) DESC, an.hour_of_day LIMIT 20"),
        "f21_grid_counts": with_blocks(f"""SELECT CAST(least(floor((speed_avg - x0) / (x1 - x0) * 30), 29) AS BIGINT) AS x_cell, CAST(least(floor(({TARGET} - y0) / (y1 - y0) * 30), 29) AS BIGINT) AS y_cell, count(*) AS row_count
            FROM an, (SELECT min(speed_avg) AS x0, max(speed_avg) AS x1, min({TARGET}) AS y0, max({TARGET}) AS y1 FROM an WHERE speed_avg IS NOT NULL AND {TARGET} IS NOT NULL) WHERE speed_avg IS NOT NULL AND {TARGET} IS NOT NULL GROUP BY 1, 2"""),
        "f22_linear_trend": with_blocks(f"SELECT feature, count(*) AS n, {rounded('regr_slope(y, x)')} AS slope, {rounded('regr_intercept(y, x)')} AS intercept FROM pt GROUP BY feature"),
        "f23_box_statistics": r("category, n, q1:r, median:r, q3:r, whisker_low:r, whisker_high:r, outliers", "bx"),
        "f24_kruskal_wallis": r("feature, kw_statistic:r, degrees_of_freedom", "kw"),
        "f26_map_points": with_blocks(f"SELECT {rounded('lat')} AS lat, {rounded('lon')} AS lon, {rounded('e')} AS route_eff, type FROM (SELECT lat_start AS lat, lon_start AS lon, {TARGET} AS e, 'start' AS type FROM an UNION ALL SELECT lat_end, lon_end, {TARGET}, 'end' FROM an) WHERE lat IS NOT NULL AND lon IS NOT NULL AND e IS NOT NULL"),
        "f27_temporal_summary": with_blocks(_temporal("hour_of_day", "CAST(hour_of_day AS VARCHAR)") + " UNION ALL " + _temporal("day_of_week", "(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'])[CAST(day_of_week AS INT) + 1]")),
        "f28_percentile_profile": with_blocks(" UNION ALL ".join(_percentiles(c) for c in (TARGET, "idle_efficiency_mean", "time_efficiency_mean"))),
        "f29_describe": _describe("fl"),
        "f30_insights": with_blocks(f"""SELECT category, finding, action FROM (VALUES
            (1, 'Idle Management', 'High idle time correlates with lower efficiency', 'Optimize routes, schedules, and driver behavior to minimize stops'),
            (2, 'Speed Management', 'Speed variability impacts efficiency', 'Driver coaching, cruise control, route optimization'),
            (3, 'Scheduling', 'Peak hours reduce efficiency', 'Time-shift operations and use dynamic routing'),
            (4, 'Route Planning', 'Indirect routes reduce efficiency', 'Improve routing algorithms and map data quality'),
            (5, 'Data Quality', 'GPS signal issues affect measurement', 'Hardware maintenance and data filtering')) v(nr, category, finding, action)
            WHERE nr IN (SELECT unnest([CASE WHEN contains(feature, 'idle') OR contains(feature, 'stops') THEN 1 END, CASE WHEN contains(feature, 'speed') THEN 2 END,
              CASE WHEN feature IN ('is_peak_hour', 'hour_of_day') THEN 3 END, CASE WHEN feature = 'route_directness' AND spearman_r > 0 THEN 4 END, CASE WHEN feature = 'signal_reliability' THEN 5 END])
              FROM (SELECT * FROM rk ORDER BY abs(spearman_r) DESC, feature LIMIT 10))"""),
        "f31_correlation_t": with_blocks(f"SELECT feature, n, {rounded('pearson_r * sqrt((n - 2) / nullif(1 - pearson_r * pearson_r, 0))')} AS pearson_t, {rounded('spearman_r * sqrt((n - 2) / nullif(1 - spearman_r * spearman_r, 0))')} AS spearman_t FROM rk"),
        "g01_speed_by_day": with_blocks("SELECT strftime(make_timestamp(timestamp_start * 1000000), '%d') AS time, round_even(round(avg(Avg_Speed), 6), 2) + 0.0 AS value FROM et GROUP BY 1"),
        "g02_driver_ranking": r("rank, vehicle, time:r", "rank"),
        "g03_direction_breakdown": with_blocks("""SELECT position, data FROM (VALUES ('north'), ('east'), ('south'), ('west')) v(position) LEFT JOIN (SELECT CASE WHEN direction BETWEEN 1 AND 90 THEN 'north' WHEN direction BETWEEN 91 AND 180 THEN 'east'
            WHEN direction BETWEEN 181 AND 270 THEN 'south' WHEN direction BETWEEN 271 AND 360 THEN 'west' END AS position, count(*) AS data FROM t WHERE direction <> 0 GROUP BY 1) USING (position)"""),
        "g04_vehicle_list": with_blocks("SELECT DISTINCT vehicle_id FROM vd"),
        "g05_thinned_track": _thinned("t", 0.005),
        "g06_thinned_idle_track": _thinned("(SELECT * FROM er WHERE is_idle)", 0.001),
        "g07_vehicle_stats": with_blocks("""SELECT vehicle_id, month_total_distance, fuel_liters, round_even(round(fuel_liters * 2.89::DOUBLE, 6), 2) + 0.0 AS total_wasted, day_total_distance_avg, total_idle_min FROM (
            SELECT *, round_even(round(35 * (month_total_distance / 100), 6), 2) + 0.0 AS fuel_liters FROM (SELECT vehicle_id, round_even(round(sum(Total_Distance_km), 6), 2) + 0.0 AS month_total_distance,
            round_even(round(avg(Total_Distance_km) FILTER (Total_Distance_km <> 0), 6), 2) + 0.0 AS day_total_distance_avg, round_even(round(coalesce(sum(Total_Idle_min) FILTER (Total_Idle_min <> 0), 0), 6), 0) + 0.0 AS total_idle_min FROM vd GROUP BY vehicle_id))"""),
        "g08_next_trip_features": with_blocks("SELECT vehicle_id, arg_max(timestamp_start, trip_id) AS timestamp_start, " + ", ".join(f"{rounded(f'arg_max({c}, trip_id)', 4)} AS {c}" for c in ENDS) + ", "
            + ", ".join(f"{rounded(f'avg({c})', 4)} AS {c}" for c in ("Trip_Distance_km", "Trip_Duration_min", "Idle_Time_min", "Moving_Time_min", "Avg_Speed", "Idle_Percentage", "Age_of_Truck_months"))
            + " FROM et WHERE lat_start <> 0 AND lat_end <> 0 AND lon_start <> 0 AND lon_end <> 0 GROUP BY vehicle_id"),
        "g09_map_box": with_blocks(f"SELECT vehicle_id, s, {rounded('lat * 2')} AS lat, {rounded('lon')} AS lon FROM t WHERE lat * 2 BETWEEN 1 AND 7 AND lon BETWEEN 100 AND 119"),
        "g10_hours_minutes": with_blocks("SELECT vehicle, printf('%02dh %02dm', CAST(floor(round(time, 6) + 0.5) AS BIGINT) // 60, CAST(floor(round(time, 6) + 0.5) AS BIGINT) % 60) AS driven FROM rank"),
        "g11_efficiency_percent": with_blocks("SELECT trip_id, round(floor(Idle_Efficiency * 100 * 100 + 0.5) / 100 + 1e-9, 5) + 0.0 AS percent FROM et"),
        "h01_speed_profile": r("trip_id, speed_mean:r, speed_median:r, speed_p25:r, speed_p75:r, speed_p90:r, speed_std:r, speed_min:r, speed_max:r, speed_iqr:r, speed_cv:r", "ta"),
        "h02_stop_overspeed": r("trip_id, stop_count, overspeed_count, telemetry_rows", "ta"),
        "h03_idle_moving_shares": r("trip_id, idle_event_count, idle_percentage_rows:r, moving_event_count, moving_percentage_rows:r", "ta"),
        "h04_aggregate_join": r("trip_id, Trip_Distance_km:r, speed_mean:r, stop_count, idle_event_count, moving_event_count", "tj"),
        "h05_rates": r("trip_id, stop_count_per_100km:r, overspeed_count_per_100km:r, idle_events_per_100km:r, stop_count_per_hour:r, overspeed_count_per_hour:r", "tj"),
        "h06_training_filter": r("trip_id, Trip_Distance_km:r, Trip_Duration_min:r", "tr"),
        "h07_geo_features": r("trip_id, haversine_km:r, bearing:r, delta_lat:r, delta_lon:r", "fr"),
        "h08_detour": r("trip_id, detour_ratio:r, directness_efficiency:r", "fr", 4),
        "h09_cyclical_time": r("trip_id, hour_sin:r, hour_cos:r, dow_sin:r, dow_cos:r", "fr"),
        "h10_operational_ratios": r("trip_id, idle_ratio:r, moving_ratio:r, idle_per_km:r", "fr"),
        "h11_distance_bucket": r("trip_id, distance_bucket", "fr"),
        "h12_target_fixed_speed": r("trip_id, route_efficiency:r", "fr"),
        "h13_target_bucket_speed": with_blocks(f"SELECT trip_id, {rounded('speed_efficiency')} AS speed_efficiency, {rounded('0.5::DOUBLE * directness_efficiency + 0.3::DOUBLE * (1 - idle_ratio) + 0.2::DOUBLE * speed_efficiency')} AS route_efficiency FROM b2"),
        "h14_time_split": r("trip_id, is_train", "fr"),
        "h16_target_encoding": with_blocks(f"SELECT trip_id, {rounded('coalesce(vm, (SELECT avg(route_efficiency) FROM fr WHERE is_train))')} AS vehicle_id_encoded FROM fr LEFT JOIN (SELECT vehicle_id, avg(route_efficiency) AS vm FROM fr WHERE is_train GROUP BY 1) USING (vehicle_id)"),
        "h18_null_fill": with_blocks(f"SELECT trip_id, {rounded('coalesce(Age_of_Truck_months, 0)')} AS Age_of_Truck_months, {rounded('coalesce(Avg_Speed, 0)')} AS Avg_Speed, {rounded('coalesce(speed_std, 0)')} AS speed_std FROM fr"),
        "h27_target_correlations": with_blocks("SELECT " + ", ".join(f"{rounded(f'corr(route_efficiency, {c})', 6)} AS corr_{c.lower()}" for c in ("Distance_Efficiency", "Time_Efficiency", "Idle_Efficiency")) + " FROM fr"),
        "h28_scoring_defaults": r("trip_id, " + ", ".join(f"{c}:r" for c in ("speed_mean", "speed_median", "speed_p25", "speed_p75", "speed_p90", "speed_std", "speed_min", "speed_max", "speed_iqr", "speed_cv")), "rs2"),
        "h29_scoring_counts": with_blocks(f"SELECT trip_id, coalesce(stop_count, 0) AS stop_count, CAST(0 AS BIGINT) AS overspeed_count, telemetry_rows, {rounded('idle_event_count / (telemetry_rows + 1e-6)')} AS idle_percentage_rows, {rounded('moving_event_count / (telemetry_rows + 1e-6)')} AS moving_percentage_rows, {rounded('coalesce(stop_count, 0) / (Trip_Duration_min / 60 + 1e-6)')} AS stop_count_per_hour FROM rc"),
        "h30_request_validation": r("trip_id, rejected_fields", "rv"),
        **model_checks(with_blocks, rounded),
    }
    return sql


# Fixed values, written out: numeric inputs of the telemetry model in order.
TELEMETRY_INPUTS = """Trip_Distance_km Trip_Duration_min Avg_Speed Idle_Time_min Moving_Time_min Idle_Percentage haversine_km bearing
    delta_lat delta_lon lat_start lon_start lat_end lon_end hour_sin hour_cos dow_sin dow_cos Age_of_Truck_months speed_mean speed_median
    speed_p25 speed_p75 speed_p90 speed_std speed_iqr speed_cv stop_count stop_count_per_100km stop_count_per_hour overspeed_count
    overspeed_count_per_100km overspeed_count_per_hour idle_event_count idle_percentage_rows idle_events_per_100km moving_event_count
    moving_percentage_rows""".split()


def chi_square_tail_sql(x: str, freedom: str, steps: int = 4000) -> str:
    """Upper tail as 1 - the integral of the chi density up to sqrt(x), by Simpson's rule."""
    return (f"1 - (SELECT sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * CASE WHEN i = 0 THEN CASE WHEN {freedom} = 1 THEN 1 ELSE 0 END "
            f"ELSE exp(({freedom} - 1) * ln(sqrt({x}) * i / {steps}) - {x} * i * i / ({steps}.0::DOUBLE * {steps}) / 2) END) "
            f"* sqrt({x}) / {steps} / 3 / exp(({freedom} / 2.0::DOUBLE - 1) * ln(2.0::DOUBLE) + lgamma({freedom} / 2.0::DOUBLE)) FROM range({steps} + 1) g(i))")


def student_tail_sql(t: str, freedom: str, steps: int = 20000) -> str:
    """Both tails as 1 - twice the integral of the density up to |t| (beyond 40 nothing is left to add)."""
    top = f"least(abs({t}), 40.0::DOUBLE)"
    return (f"1 - 2 * (SELECT sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
            f"* exp(-({freedom} + 1) / 2.0::DOUBLE * ln(1 + pow({top} * i / {steps}, 2) / {freedom}))) * {top} / {steps} / 3 "
            f"* exp(lgamma(({freedom} + 1) / 2.0::DOUBLE) - lgamma({freedom} / 2.0::DOUBLE)) / sqrt(pi() * {freedom}) FROM range({steps} + 1) g(i))")


def model_checks(with_blocks, rounded) -> dict[str, str]:
    """What SQL can say about tail probabilities, samples, encodings and trained models."""
    t = "{r} * sqrt((n - 2) / nullif(1 - {r} * {r}, 0))"
    tests = ", ".join(f"{t.format(r=c + '_r')} AS {c}_t" for c in ("pearson", "spearman"))
    encoded = "SELECT fr.*, coalesce(vm, (SELECT avg(route_efficiency) FROM fr WHERE is_train)) AS vehicle_id_encoded FROM fr LEFT JOIN (SELECT vehicle_id, avg(route_efficiency) AS vm FROM fr WHERE is_train GROUP BY 1) USING (vehicle_id)"
    scaled = lambda c: f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) FILTER (is_train) OVER ()) / stddev_samp(coalesce({c}, 0)) FILTER (is_train) OVER ()"
    splits = "(SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM fr GROUP BY 1)"
    scores = f"SELECT model, split, n, true AS mae_below_rmse, true AS r2_at_most_1, true AS learnt FROM (VALUES ('ridge'), ('boosted_trees')) v(model), {splits}"
    inputs = ", ".join(f"('{c}')" for c in [*TELEMETRY_INPUTS, "vehicle_id_encoded"])
    return {
        "f24_kruskal_pvalues": with_blocks(f"SELECT feature, {rounded('kw_statistic', 9)} AS kw_statistic, degrees_of_freedom, {rounded(chi_square_tail_sql('kw_statistic', 'degrees_of_freedom'), 9)} AS kw_pvalue FROM kw"),
        "f25_sample_rows": with_blocks("SELECT vehicle_id, s, event_id, round(speed_kmh, 6) AS speed_kmh FROM er ORDER BY md5(concat(event_id, ':42')), event_id LIMIT 20000"),
        "f25_seeded_sample": with_blocks("SELECT least(count(*), 500) AS sample_rows, least(count(*), 500) AS distinct_rows, least(count(*), 500) AS rows_in_table, least(count(*), 500) AS rows_repeated FROM er"),
        "f31_correlation_pvalues": with_blocks("SELECT feature, n, " + ", ".join(f"{rounded(c, 9)} AS {c}" for c in ("pearson_r", "spearman_r", "pearson_t", "spearman_t")) + ", "
                                               + ", ".join(f"{rounded(student_tail_sql(c + '_t', '(n - 2)'), 9)} AS {c}_p" for c in ("pearson", "spearman")) + f" FROM (SELECT *, {tests} FROM rk)"),
        "h15_zones": with_blocks("SELECT trip_id, true AS zone_start_id_valid, 1::BIGINT AS zone_start_id_per_point, true AS zone_end_id_valid, 1::BIGINT AS zone_end_id_per_point FROM fr"),
        "h17_one_hot": with_blocks("SELECT trip_id, s.distance_bucket AS level, CASE WHEN s.distance_bucket IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS flags_set, true AS zones_valid "
                                   "FROM fr LEFT JOIN (SELECT DISTINCT distance_bucket FROM fr WHERE is_train) s USING (distance_bucket)"),
        "h19_feature_vector": with_blocks(f"SELECT trip_id, true AS width_fits, {', '.join(f'{rounded(f"coalesce({c}, 0)")} AS slot_{c.lower()}' for c in [*TELEMETRY_INPUTS, 'vehicle_id_encoded'])} FROM ({encoded})"),
        "h20_scaled_features": with_blocks(f"SELECT trip_id, {rounded('a')} AS trip_distance_scaled, {rounded('b')} AS avg_speed_scaled FROM (SELECT trip_id, {scaled('Trip_Distance_km')} AS a, {scaled('Avg_Speed')} AS b FROM fr)"),
        **{name: with_blocks(f"SELECT trip_id, is_train, {rounded('route_efficiency')} AS route_efficiency, true AS prediction_finite FROM fr") for name in ("h21_ridge", "h22_boosted_trees")},
        "h23_regression_metrics": with_blocks(scores),
        "h23_trips_model": with_blocks(scores),
        "h24_feature_importance": (f"SELECT feature, regexp_matches(feature, 'speed|stop|idle|overspeed|moving') AS is_telemetry, regexp_matches(feature, 'lat|lon|haversine|bearing|delta|zone') AS is_geo, "
                                              f"regexp_matches(feature, 'hour|dow') AS is_time, true AS not_negative, true AS adds_up FROM (VALUES {inputs}) v(feature)"),
        "h25_model_comparison": "SELECT true AS mae_named, true AS r2_named, true AS gain_follows",
        "h26_model_bundle": with_blocks(f"SELECT 'spark_gbt_v1' AS model_version, 'telemetry' AS feature_set, {rounded('avg(route_efficiency) FILTER (is_train)')} AS global_mean, {rounded('1e-6::DOUBLE')} AS epsilon, 3.0::DOUBLE AS stop_threshold_kmh, "
                                        "90.0::DOUBLE AS overspeed_threshold_kmh, count(*) FILTER (is_train) AS train_size, count(*) FILTER (NOT is_train) AS test_size, true AS rounds_valid, true AS mae_valid FROM fr"),
        "h31_batch_scoring": with_blocks("SELECT rv.trip_id, fr.vehicle_id, rejected_fields, rejected_fields = '' AS scored, true AS in_range FROM rv JOIN fr USING (trip_id)"),
    }
