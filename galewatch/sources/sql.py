"""The same lifts as DuckDB common table expressions, for the oracles."""

OBS_BODY = """SELECT (user_id % 66)::BIGINT AS node_id, ((user_id % 66) // 6)::BIGINT AS lat_i, ((user_id % 66) % 6)::BIGINT AS lon_i,
  date_trunc('{unit}', ts)::TIMESTAMP AS valid_time, avg(value) AS value,
  10 + 0.5 * ((user_id % 66) // 6) AS latitude, 76.0 + ((user_id % 66) % 6) AS longitude FROM events GROUP BY ALL"""
OBS = "obs AS (" + OBS_BODY.format(unit="day") + ")"
OBS_HOUR = "obs AS (" + OBS_BODY.format(unit="hour") + ")"
CLIM = OBS + """, clim AS (SELECT lat_i, lon_i, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM obs GROUP BY ALL)"""
Z = CLIM + """, zs AS (SELECT o.*, (o.value - c.mean) / greatest(c.std, 1e-6) AS z FROM obs o JOIN clim c USING (lat_i, lon_i))"""
FLAG = Z + """, flags AS (SELECT * FROM zs WHERE z > 1.0)"""
REGION = FLAG + """, walk AS (
  SELECT valid_time, node_id, node_id AS root FROM flags
  UNION
  SELECT f.valid_time, f.node_id, w.root FROM walk w JOIN flags a ON a.valid_time = w.valid_time AND a.node_id = w.node_id
  JOIN flags f ON f.valid_time = w.valid_time AND abs(f.lat_i - a.lat_i) + abs(f.lon_i - a.lon_i) = 1),
lab0 AS (SELECT valid_time, node_id, min(root) AS root FROM walk GROUP BY ALL),
labels_ AS (SELECT l.valid_time, l.node_id, l.root, dense_rank() OVER (PARTITION BY l.valid_time ORDER BY l.root)::BIGINT AS label_id, f.latitude, f.longitude, f.z
  FROM lab0 l JOIN flags f USING (valid_time, node_id))"""
BOX = REGION + """, boxes AS (SELECT valid_time, label_id, min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max,
  avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon, max(z) AS peak_zscore, count(*)::BIGINT AS cell_count FROM labels_ GROUP BY ALL HAVING count(*) >= 2)"""
TOP = BOX + """, top AS (SELECT * FROM boxes QUALIFY row_number() OVER (PARTITION BY valid_time ORDER BY peak_zscore DESC, label_id) = 1)"""
HAV = "2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin((radians({d}) - radians({c})) / 2), 2), 0.0), 1.0)))"
FINE = "fine AS (SELECT (l_partkey % 20)::BIGINT AS i, (l_orderkey % 20)::BIGINT AS j, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"
SERIES = "series AS (SELECT o_orderpriority AS threat_id, date_trunc('month', o_orderdate)::TIMESTAMP AS \"timestamp\", sum(o_totalprice) AS severity, count(*)::DOUBLE AS radius FROM orders GROUP BY ALL)"
SCORES = "scores AS (SELECT doc_id, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS p, toxic::INT AS y FROM labels)"
