"""Queries over contracts, names, units, lookups and the serving views of threats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.meteo import wind_speed as hypot
from ..operators import alignment, contracts, serving
from ..sources import sql as S
from ..sources.tables import coarse_field, fine_field, monthly_series, observations, table

SEVERITIES = ("moderate", "severe", "extreme")


def threats(spark: SparkSession, d: str) -> DataFrame:
    """A threat for every priority and year of orders: threat_id, severity (dealt by the peak's last whole digit, so that
    all occur at every size), peak, first and last time, orders."""
    rank = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.floor("peak") % 3 + 1).cast("int"))
    per = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.substring("o_orderpriority", 1, 1).cast("int").alias("number")).agg(
        F.max("o_totalprice").alias("peak"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("orders")
    )
    return per.withColumn("severity", rank).withColumn("threat_id", T.threat_id(F.col("year"), F.col("number")))


def enum_coercion(spark, d):
    """Order states written in other cases and with blanks, brought back to their names."""
    words = {"F": " Severe", "O": "MODERATE ", "P": "none"}
    raw = T.looked_up(words, F.col("o_orderstatus"))
    return table(spark, d, "orders").groupBy(T.one_of(raw, SEVERITIES).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def day_ranges(spark, d):
    """Days of ranges "a-b" made of a nation's keys; NULL where a is beyond b."""
    days = T.day_range(F.concat_ws("-", F.col("n_nationkey"), F.col("n_regionkey") * 5))
    return table(spark, d, "nation").select("n_nationkey", F.size(days).alias("days"), F.aggregate(days, F.lit(0), lambda a, x: a + x).alias("total")).select("n_nationkey", F.when(F.col("total").isNotNull(), F.col("days")).cast("double").alias("days"), F.col("total").cast("double").alias("total"))


def colour_ramp(spark, d):
    """Colour of every part's price between 950 and 1050."""
    f = T.ramp_fraction(F.col("p_retailprice"), F.lit(950.0), F.lit(1050.0))
    return table(spark, d, "part").select("p_partkey", T.ramp_colour(f, (255, 240, 200), (120, 0, 30)).alias("colour"))


def ring_checks(spark, d):
    """What is wrong with rings around suppliers, by how many have it: some are open, short or beyond the pole."""
    at, k = F.col("s_acctbal") / 100, F.col("s_suppkey") % 4
    point = lambda x, y: F.array((at + x).cast("double"), (at / 2 + 40 + y).cast("double"))
    ring = F.when(k == 0, F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 0))).when(k == 1, F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 1))).when(k == 2, F.array(point(0, 0), point(1, 0), point(0, 0)))
    return table(spark, d, "supplier").groupBy(T.ring_problem(ring).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def metric_directions(spark, d):
    """Metrics of every return flag as a map without NULLs, and in which direction each is better."""
    better = {"mean_price": "higher", "mean_discount": "lower"}
    per = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("a"), F.avg("l_discount").alias("b"), F.max(F.when(F.col("l_quantity") > 60, 1.0)).alias("c"))
    named = F.create_map(F.lit("mean_price"), F.round("a", 4), F.lit("mean_discount"), F.round("b", 6), F.lit("none"), F.col("c"))
    return per.select("l_returnflag", F.explode(T.known_metrics(named)).alias("metric", "value")).withColumn("better", T.looked_up(better, F.col("metric")))


def json_aliases(spark, d):
    """Transition records read from JSON, whichever of two names a field comes under."""
    o = table(spark, d, "orders").where("o_orderkey % 5 = 0")
    odd, hours = F.col("o_orderkey") % 2 == 1, F.col("o_custkey") % 3 * 12
    flat = F.to_json(F.struct(F.col("o_orderstatus").alias("target_state"), hours.alias("window_hours"), F.lit(0.5).alias("probability")))
    nested = F.to_json(F.struct(F.col("o_orderstatus").alias("target_severity"), F.struct((hours + 24).alias("hours")).alias("window")))
    r = T.transition_from_json(F.when(odd, flat).otherwise(nested))
    return o.groupBy(r["target_state"].alias("target_state"), r["window_hours"].alias("window_hours"), r["probability"].alias("probability")).agg(F.count(F.lit(1)).alias("n"))


def band_labels(spark, d):
    """Months of every series above and below its 75 % quantile."""
    rows = monthly_series(spark, d)
    cut = rows.groupBy("threat_id").agg(F.percentile("severity", F.lit(0.75)).alias("cut"))
    return rows.join(cut, "threat_id").groupBy("threat_id", T.band_label(0.75, F.col("severity") >= F.col("cut")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def threat_contract(spark, d):
    """Broken rules of the threat contract, also those that hold."""
    rows = threats(spark, d).select(
        "threat_id", "severity", (F.col("orders") / 100.0).alias("probability"), F.when(F.col("orders") % 2 == 0, "m").alias("model_id"),
        F.col("first").alias("earliest"), F.col("first").alias("likely"), F.col("last").alias("latest"), F.lit(None).cast("array<array<double>>").alias("ring"),
    )
    return contracts.violations(rows, contracts.threat_rules())


def score_contract(spark, d):
    """Broken rules of labels taken for scores: toxic as outcome, quality less a quarter as probability."""
    rows = table(spark, d, "labels").select((F.col("quality") - 0.25).alias("p"), F.col("toxic").alias("y"))
    return contracts.violations(rows, contracts.score_rules())


def cube_contract(spark, d):
    """Broken rules of the daily cube of 66 nodes: frames that lack nodes, repeat one, or follow at another step."""
    return contracts.violations(contracts.cube_frames(observations(spark, d)), contracts.cube_rules(66, 24.0, 0.0))


def repeated_timestamps(spark, d):
    """Days that two overlapping blocks of a series both have: what joining the blocks would refuse."""
    days = observations(spark, d).select("node_id", "valid_time")
    a, b = days.where("day(valid_time) <= 16"), days.where("day(valid_time) >= 14")
    return contracts.repeated(a.unionByName(b), "node_id", "valid_time").groupBy("valid_time").agg(F.count(F.lit(1)).alias("nodes"))


def timestamp_difference(spark, d):
    """Days that only views or only clicks have, by node and side."""
    e = table(spark, d, "events").select((F.col("user_id") % 66).alias("node_id"), F.to_date("ts").alias("day"), "event_type")
    first, last = (e.agg(f("event_type").alias("k")).first()["k"] for f in (F.min, F.max))
    got = contracts.set_difference(e.where(F.col("event_type") == first), e.where(F.col("event_type") == last), "node_id", "day")
    return got.groupBy("node_id", "side").agg(F.count(F.lit(1)).alias("n"))


def unit_projection(spark, d):
    """Mean of three made-up variables of events in the units that people read."""
    e = table(spark, d, "events").select(F.when(F.col("user_id") % 3 == 0, "msl").when(F.col("user_id") % 3 == 1, "t2m").otherwise("other").alias("variable"), "value")
    shown = alignment.in_display_units(F.col("variable"), F.col("value"))
    return e.groupBy("variable", alignment.unit_of(F.col("variable")).alias("unit")).agg(F.round(F.avg(shown), 6).alias("mean"))


def time_slice(spark, d):
    """The first event type of every node on the fifth day."""
    obs = observations(spark, d, "day", True)
    start = obs.agg(F.min("valid_time").alias("t")).first()["t"]
    got = alignment.time_slice(obs, F.lit(start).cast("timestamp_ntz") + F.expr("INTERVAL 4 DAYS"), ["event_type"], ["node_id"])
    return got.select("node_id", "event_type", F.round("value", 6).alias("value"))


def footprint_mask(spark, d):
    """A field kept only where the coarse field has a value."""
    fine = fine_field(spark, d)
    pairs = fine.select("i", "j", F.col("value").alias("p")).join(coarse_field(fine).select("i", "j", F.col("value").alias("r")), ["i", "j"], "left")
    return alignment.within_footprint(pairs).groupBy((F.col("i") % 4).alias("row")).agg(F.count("p").alias("kept"), F.round(F.avg("p"), 4).alias("mean"))


def coordinate_lookup(spark, d):
    """Cells of the mesh looked up by coordinates that differ in the tenth decimal only."""
    cells = observations(spark, d).groupBy("latitude", "longitude").agg(F.avg("value").alias("mean"))
    wanted = cells.select((F.col("latitude") + 1e-10).alias("latitude"), (F.col("longitude") - 1e-10).alias("longitude")).where("latitude < 12")
    got = alignment.exact_lookup(wanted, cells)
    return got.select(F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round("mean", 6).alias("mean"))


def temporal_alignment(spark, d):
    """Positions of two priorities' months side by side, and how many of them hold different months."""
    rows = monthly_series(spark, d)
    names = [r["threat_id"] for r in rows.select("threat_id").distinct().orderBy("threat_id").limit(2).collect()]
    a, b = (rows.where(F.col("threat_id") == n) for n in names)
    pairs = alignment.in_step(a, b, "timestamp")
    return pairs.agg(F.count(F.lit(1)).alias("steps"), F.count(F.when(F.col("coarse_time") != F.col("fine_time"), 1)).alias("apart"))


def region_files(spark, d):
    """Files of every region by the rule for old names: only one region may use those, if it has no others."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listing = nations.select(F.col("n_name").alias("path"), F.when(~F.col("r_name").isin("ASIA"), F.col("r_name")).alias("region"))
    out = None
    for r in ("AFRICA", "ASIA"):
        got = alignment.region_files(listing, r, "ASIA").select(F.lit(r).alias("wanted"), "path")
        out = got if out is None else out.unionByName(got)
    return out


def grid_mean_series(spark, d):
    return alignment.grid_mean_series(observations(spark, d)).select("valid_time", F.round("mean", 6).alias("mean"))


def inner_split(spark, d):
    """The first 85 % of a field's columns train, the others validate."""
    parts = alignment.axis_split(fine_field(spark, d), "j")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("columns"), F.min("j").alias("low"), F.max("j").alias("high"))


def training_cut(spark, d):
    """Frames before the pilot, which starts ten days after the first frame; they must end right before it."""
    obs = observations(spark, d)
    start = obs.agg((F.min("valid_time") + F.expr("INTERVAL 10 DAYS")).alias("t")).first()["t"]
    kept = alignment.before_pilot(obs, str(start), "INTERVAL 1 DAY")
    return kept.agg(F.countDistinct("valid_time").alias("frames"), F.max("valid_time").alias("last"))


def axis_resolution(spark, d):
    return alignment.axis_resolution(observations(spark, d)).select(F.round("step", 6).alias("step"), F.round("km", 4).alias("km"))


def trough_frame(spark, d):
    return alignment.peak_frame(observations(spark, d), "low").select("valid_time", F.round("peak", 6).alias("peak"))


def bump_field(spark, d):
    """Peaks around suppliers at the cells of the mesh: how high the highest one stands over each cell."""
    cells = observations(spark, d).select("node_id", "lat_i", "lon_i").distinct()
    at = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 11).alias("y"), (F.col("s_nationkey") % 6).alias("x")).agg(F.max("s_acctbal").cast("double").alias("amplitude"))
    spots = cells.join(F.broadcast(at))  # at most 66 centres
    distance = F.sqrt(F.pow(F.col("lat_i") - F.col("y"), 2) + F.pow(F.col("lon_i") - F.col("x"), 2))
    high = alignment.bump(distance, F.col("amplitude"), F.lit(1.0), F.lit(1.5))
    return spots.groupBy("node_id").agg(F.round(F.max(high), 4).alias("value"))


def wind_speed(spark, d):
    """Speed of the mean wind of every node: components are averaged first."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 66).alias("node_id")).agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("u"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("v"))
    return e.select("node_id", F.round(hypot(F.col("u"), F.col("v")), 6).alias("speed"))


def threat_list(spark, d):
    """The first twenty threats of a severity."""
    return serving.threat_list(threats(spark, d), "severe", 20).select("threat_id", "severity", "peak")


def threat_lookup(spark, d):
    return serving.lookup(threats(spark, d), "THR-1995-0002").select("threat_id", "severity", "orders")


def alert_floor(spark, d):
    """Alerts from severe on, with how many there are."""
    return serving.alerts(threats(spark, d), "severe").select("threat_id", "severity", "total")


def equal_alerts(spark, d):
    """Cells by tier of their z score with the fixed radius; a wanted tier is matched exactly."""
    obs = observations(spark, d)
    w = Window.partitionBy("node_id")
    z = (F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_pop("value").over(w), F.lit(1e-6))
    return serving.legacy_alerts(obs.withColumn("z", z), "moderate").select("node_id", "valid_time", F.round("z", 6).alias("z"), "tier", "radius")


def latest_alert(spark, d):
    """What is served as the latest alert: the one with the highest z score of each node."""
    obs = observations(spark, d)
    w = Window.partitionBy("node_id")
    z = (F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_pop("value").over(w), F.lit(1e-6))
    return serving.strongest(obs.withColumn("z", F.round(z, 9)), "node_id").select("node_id", "valid_time", F.round("z", 6).alias("z"))


def health(spark, d):
    """Stages with their flags; healthy only if every one has rows."""
    return serving.health({"events": table(spark, d, "events"), "orders": table(spark, d, "orders"), "none": table(spark, d, "labels").where("toxic > 1")})


def history_contract(spark, d):
    """Broken rules of histories: the months of every customer's orders, some of them twice."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("threat_id"), F.date_trunc("month", "o_orderdate").alias("timestamp"))
    return contracts.violations(contracts.with_previous(rows), contracts.history_rules())


def enriched_threats(spark, d):
    """Threats beside the mean discount of their year, which later years do not have."""
    early = table(spark, d, "lineitem").where("l_shipdate < '1996-01-01'")
    lookup = early.groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.avg("l_discount"), 6).alias("discount"))
    return alignment.enrich(threats(spark, d), lookup, "year").select("threat_id", "discount")


def footprint_variants(spark, d):
    """Downscaled months where the large orders give one, else the coarse ones."""
    o = table(spark, d, "orders").withColumn("m", F.date_trunc("month", "o_orderdate"))
    coarse = o.groupBy("o_orderpriority", "m").agg(F.round(F.avg("o_totalprice"), 4).alias("area"))
    fine = o.where("o_totalprice > 400000").groupBy("o_orderpriority", "m").agg(F.round(F.avg("o_totalprice"), 4).alias("area"))
    got = serving.variant(coarse, fine, "area", "o_orderpriority", "m")
    return got.groupBy("o_orderpriority", "downscaled").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("area"), 3).alias("area"))


_THREATS = """threats AS (SELECT *, CASE floor(peak)::BIGINT % 3 WHEN 0 THEN 'moderate' WHEN 1 THEN 'severe' ELSE 'extreme' END AS severity, 'THR-' || lpad(year::VARCHAR, 4, '0') || '-' || lpad(number::VARCHAR, 4, '0') AS threat_id
 FROM (SELECT year(o_orderdate) AS year, left(o_orderpriority, 1)::INT AS number, max(o_totalprice) AS peak, min(o_orderdate) AS "first", max(o_orderdate) AS "last", count(*) AS orders FROM orders GROUP BY ALL))"""
_NODE_Z = S.OBS + ", zn AS (SELECT node_id, valid_time, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6) AS z FROM obs WINDOW w AS (PARTITION BY node_id))"
_TYPED = "t AS (" + S.OBS_BODY.format(unit="day").replace("AS valid_time,", "AS valid_time, event_type,") + ")"
SQL = {
    "enum_coercion": "SELECT CASE o_orderstatus WHEN 'F' THEN 'severe' WHEN 'O' THEN 'moderate' END AS severity, count(*) AS n FROM orders GROUP BY ALL",
    "day_ranges": "SELECT n_nationkey, CASE WHEN n_nationkey <= n_regionkey * 5 THEN n_regionkey * 5 - n_nationkey + 1 END::DOUBLE AS days, CASE WHEN n_nationkey <= n_regionkey * 5 THEN (n_nationkey + n_regionkey * 5) * (n_regionkey * 5 - n_nationkey + 1) // 2 END::DOUBLE AS total FROM nation",
    "colour_ramp": "WITH f AS (SELECT p_partkey, least(greatest((p_retailprice - 950.0) / 100.0, 0.0), 1.0)::DOUBLE AS f FROM part) SELECT p_partkey, '#' || printf('%02x', floor(255 + f * -135 + 0.5)::INT) || printf('%02x', floor(240 + f * -240 + 0.5)::INT) || printf('%02x', floor(200 + f * -170 + 0.5)::INT) AS colour FROM f",
    "ring_checks": "SELECT CASE WHEN s_suppkey % 4 = 3 THEN 'missing' WHEN s_suppkey % 4 = 2 THEN 'fewer than four points' WHEN s_suppkey % 4 = 1 THEN 'not closed' WHEN s_acctbal / 100 < -180 OR s_acctbal / 100 + 1 > 180 OR s_acctbal / 200 + 40 < -90 OR s_acctbal / 200 + 41 > 90 THEN 'outside the globe' END AS problem, count(*) AS n FROM supplier GROUP BY ALL",
    "metric_directions": "WITH m AS (SELECT l_returnflag, round(avg(l_extendedprice), 4) AS a, round(avg(l_discount), 6) AS b FROM lineitem GROUP BY ALL) SELECT l_returnflag, 'mean_price' AS metric, a AS value, 'higher' AS better FROM m UNION ALL SELECT l_returnflag, 'mean_discount', b, 'lower' FROM m",
    "json_aliases": "SELECT o_orderstatus AS target_state, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 3 * 12 ELSE o_custkey % 3 * 12 + 24 END::DOUBLE AS window_hours, CASE WHEN o_orderkey % 2 = 1 THEN 0.5 END::DOUBLE AS probability, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL",
    "band_labels": f"WITH {S.SERIES}, c AS (SELECT threat_id, quantile_cont(severity, 0.75) AS cut FROM series GROUP BY ALL) SELECT threat_id, CASE WHEN severity >= cut THEN 'above_p0.75' ELSE 'below_p0.75' END AS band, count(*) AS n FROM series JOIN c USING (threat_id) GROUP BY ALL",
    "threat_contract": f"WITH {_THREATS}, r AS (SELECT unnest(['threat_id', 'severity', 'probability_range', 'probability_without_model', 'window_order', 'ring']) AS rule) SELECT rule, CASE rule WHEN 'probability_range' THEN (SELECT count(*) FROM threats WHERE orders > 100) WHEN 'probability_without_model' THEN (SELECT count(*) FROM threats WHERE orders % 2 = 1) ELSE 0 END AS violations FROM r",
    "score_contract": "SELECT 'probability_missing' AS rule, count(*) FILTER (quality IS NULL) AS violations FROM labels UNION ALL SELECT 'probability_range', count(*) FILTER (quality - 0.25 < 0 OR quality - 0.25 > 1) FROM labels UNION ALL SELECT 'outcome', count(*) FILTER (toxic IS NULL OR toxic NOT IN (0, 1)) FROM labels",
    "cube_contract": f"WITH {S.OBS}, f AS (SELECT valid_time, count(*) AS rows, count(DISTINCT node_id) AS nodes, count(*) FILTER (value IS NULL) AS missing, min(value) AS lowest FROM obs GROUP BY ALL), g AS (SELECT *, date_diff('second', lag(valid_time) OVER (ORDER BY valid_time), valid_time) / 3600.0 AS gap FROM f) SELECT unnest(['nodes', 'node_repeated', 'step', 'missing', 'negative']) AS rule, unnest([count(*) FILTER (nodes <> 66), count(*) FILTER (rows <> nodes), count(*) FILTER (gap <> 24), count(*) FILTER (missing > 0), count(*) FILTER (lowest < 0)]) AS violations FROM g",
    "repeated_timestamps": f"WITH {S.OBS} SELECT valid_time, count(*) AS nodes FROM obs WHERE day(valid_time) BETWEEN 14 AND 16 GROUP BY ALL",
    "timestamp_difference": "WITH e AS (SELECT DISTINCT user_id % 66 AS node_id, ts::DATE AS d, event_type FROM events), k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), x AS (SELECT node_id, d FROM e, k WHERE event_type = a), y AS (SELECT node_id, d FROM e, k WHERE event_type = b) SELECT node_id, side, count(*) AS n FROM (SELECT *, 'left' AS side FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT *, 'right' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) GROUP BY ALL",
    "unit_projection": "SELECT CASE user_id % 3 WHEN 0 THEN 'msl' WHEN 1 THEN 't2m' ELSE 'other' END AS variable, CASE user_id % 3 WHEN 0 THEN 'hPa' WHEN 1 THEN 'degC' END AS unit, round(avg(CASE user_id % 3 WHEN 0 THEN value * 0.01::DOUBLE WHEN 1 THEN value - 273.15::DOUBLE ELSE value END), 6) AS mean FROM events GROUP BY ALL",
    "time_slice": f"WITH {_TYPED} SELECT node_id, event_type, round(value, 6) AS value FROM t WHERE valid_time = (SELECT min(valid_time) FROM t) + INTERVAL 4 DAY QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY event_type) = 1",
    "footprint_mask": f"WITH {S.FINE} SELECT i % 4 AS row, count(CASE WHEN i % 2 = 0 AND j % 2 = 0 THEN value END) AS kept, round(avg(CASE WHEN i % 2 = 0 AND j % 2 = 0 THEN value END), 4) AS mean FROM fine GROUP BY ALL",
    "coordinate_lookup": f"WITH {S.OBS} SELECT round(latitude, 6)::DOUBLE AS latitude, round(longitude, 6)::DOUBLE AS longitude, round(avg(value), 6) AS mean FROM obs WHERE latitude < 11.75 GROUP BY ALL",
    "temporal_alignment": f"WITH {S.SERIES}, n AS (SELECT DISTINCT threat_id FROM series ORDER BY 1 LIMIT 2), s AS (SELECT threat_id, \"timestamp\" AS t, row_number() OVER (PARTITION BY threat_id ORDER BY \"timestamp\") AS k FROM series WHERE threat_id IN (SELECT threat_id FROM n)) SELECT count(*) AS steps, count(*) FILTER (a.t <> b.t) AS apart FROM s a JOIN s b USING (k) WHERE a.threat_id < b.threat_id",
    "region_files": "SELECT r_name AS wanted, n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA')",
    "grid_mean_series": f"WITH {S.OBS} SELECT valid_time, round(avg(value), 6) AS mean FROM obs GROUP BY ALL",
    "inner_split": f"WITH {S.FINE}, a AS (SELECT j, row_number() OVER (ORDER BY j) AS k FROM (SELECT DISTINCT j FROM fine)) SELECT CASE WHEN k <= 17 THEN 'train' ELSE 'validate' END AS part, count(*) AS columns, min(j) AS low, max(j) AS high FROM a GROUP BY ALL",
    "training_cut": f"WITH {S.OBS}, s AS (SELECT min(valid_time) + INTERVAL 10 DAY AS t FROM obs) SELECT count(DISTINCT valid_time) AS frames, max(valid_time) AS \"last\" FROM obs, s WHERE valid_time < t",
    "axis_resolution": f"WITH {S.OBS}, g AS (SELECT latitude - lag(latitude) OVER (ORDER BY latitude) AS gap FROM (SELECT DISTINCT latitude FROM obs)) SELECT round(quantile_cont(gap, 0.5)::DOUBLE, 6) AS step, round(quantile_cont(gap, 0.5)::DOUBLE * 111.32, 4) AS km FROM g",
    "trough_frame": f"WITH {S.OBS}, p AS (SELECT valid_time, min(value) AS peak FROM obs GROUP BY ALL) SELECT valid_time, round(peak, 6) AS peak FROM p ORDER BY p.peak, valid_time LIMIT 1",
    "bump_field": f"WITH {S.OBS}, c AS (SELECT DISTINCT node_id, lat_i, lon_i FROM obs), a AS (SELECT s_suppkey % 11 AS y, s_nationkey % 6 AS x, max(s_acctbal)::DOUBLE AS m FROM supplier GROUP BY ALL) SELECT node_id, round(max(m * exp(-0.5 * pow(greatest(sqrt(pow(lat_i - y, 2) + pow(lon_i - x, 2)) - 1.0, 0.0) / 1.5, 2))), 4) AS value FROM c, a GROUP BY ALL",
    "wind_speed": "WITH w AS (SELECT user_id % 66 AS node_id, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS u, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS v FROM events GROUP BY ALL) SELECT node_id, round(sqrt(u * u + v * v), 6) AS speed FROM w",
    "threat_list": f"WITH {_THREATS} SELECT threat_id, severity, peak FROM threats WHERE severity = 'severe' ORDER BY threat_id LIMIT 20",
    "threat_lookup": f"WITH {_THREATS} SELECT threat_id, severity, orders FROM threats WHERE threat_id = 'THR-1995-0002'",
    "alert_floor": f"WITH {_THREATS} SELECT threat_id, severity, count(*) OVER () AS total FROM threats WHERE severity IN ('severe', 'extreme')",
    "equal_alerts": f"WITH {_NODE_Z} SELECT node_id, valid_time, round(z, 6) AS z, 'moderate' AS tier, 5.0::DOUBLE AS radius FROM zn WHERE z >= 3 AND z < 4",
    "latest_alert": f"WITH {_NODE_Z} SELECT node_id, valid_time, round(round(z, 9), 6) AS z FROM zn QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY round(z, 9) DESC, valid_time) = 1",
    "health": "WITH s AS (SELECT 'events' AS stage, count(*) > 0 AS ok FROM events UNION ALL SELECT 'orders', count(*) > 0 FROM orders UNION ALL SELECT 'none', count(*) > 0 FROM labels WHERE toxic > 1) SELECT stage, ok, bool_and(ok) OVER () AS healthy FROM s",
    "history_contract": "WITH h AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS t FROM orders), p AS (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY t) AS q FROM h) SELECT 'time_missing' AS rule, count(*) FILTER (t IS NULL) AS violations FROM p UNION ALL SELECT 'time_repeated', count(*) FILTER (t = q) FROM p UNION ALL SELECT 'key_missing', count(*) FILTER (k IS NULL) FROM p",
    "enriched_threats": f"WITH {_THREATS}, m AS (SELECT year(l_shipdate) AS year, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate < DATE '1996-01-01' GROUP BY ALL) SELECT threat_id, discount FROM threats LEFT JOIN m USING (year)",
    "footprint_variants": "WITH o AS (SELECT *, date_trunc('month', o_orderdate) AS m FROM orders), c AS (SELECT o_orderpriority, m, round(avg(o_totalprice), 4) AS a FROM o GROUP BY ALL), f AS (SELECT o_orderpriority, m, round(avg(o_totalprice), 4) AS b FROM o WHERE o_totalprice > 400000 GROUP BY ALL) SELECT o_orderpriority, b IS NOT NULL AS downscaled, count(*) AS n, round(avg(coalesce(b, a)), 3) AS area FROM c LEFT JOIN f USING (o_orderpriority, m) GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (
    enum_coercion, day_ranges, colour_ramp, ring_checks, metric_directions, json_aliases, band_labels, threat_contract, score_contract, cube_contract, repeated_timestamps,
    timestamp_difference, unit_projection, time_slice, footprint_mask, coordinate_lookup, temporal_alignment, region_files, grid_mean_series, inner_split, training_cut,
    axis_resolution, trough_frame, bump_field, wind_speed, threat_list, threat_lookup, alert_floor, equal_alerts, latest_alert, health, history_contract, enriched_threats, footprint_variants,
)}
