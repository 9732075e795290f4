"""More registered queries: coverage, masks, uncertainty, reports, runoff."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.expressions import formula
from gridloom.functions.measures import scalar_uncertainty
from gridloom.operators import align, analyses, introspect, reduce, regions, reports, resample, runoff, transforms
from gridloom.plans import cubes
from gridloom.plans.catalogue import _HELD, _IN_BOX, _POINTS, _QUERIES, _SQL, CELL, _bias, _com, _points, _ref, _site_means, days, query, rounded


def _means(spark, d):
    return reduce.integrate(_ref(spark, d), CELL, days())


# coverage


@query("SELECT min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last FROM lineitem", cte=False)
def time_extent(spark, d):
    return introspect.time_extent(spark.read.parquet(f"{d}/lineitem.parquet").select(F.to_date("l_shipdate").alias("at")))


@query("""WITH t AS (SELECT DISTINCT make_date(year, month, 1) AS p FROM r), s AS (SELECT p - lag(p) OVER o AS b, lead(p) OVER o - p AS f FROM t WINDOW o AS (ORDER BY p)),
m AS (SELECT avg((coalesce(b, f) + coalesce(f, b)) / 2e0) AS step FROM s)
SELECT round(step, 6) AS step, (SELECT label FROM (VALUES ('3hr', 0.125e0), ('6hr', 0.25e0), ('day', 1e0), ('mon', 30e0), ('yr', 365e0)) v(label, days) ORDER BY abs(days - step) LIMIT 1) AS label FROM m""")
def frequency_label(spark, d):
    starts = _ref(spark, d).select(F.make_date("year", "month", F.lit(1)).alias("at"))
    return introspect.mean_step(starts, "at").select("step", introspect.frequency_label(F.col("step")).alias("label"))


@query("""WITH y AS (SELECT avg(g) AS y FROM (SELECT v - lag(v) OVER (ORDER BY v) AS g FROM (SELECT DISTINCT -80e0 + 20 * lat_idx AS v FROM r))),
x AS (SELECT avg(g) AS x FROM (SELECT v - lag(v) OVER (ORDER BY v) AS g FROM (SELECT DISTINCT -170e0 + 20 * lon_idx AS v FROM r)))
SELECT round(sqrt(y * y + x * x), 6) AS resolution FROM y, x""")
def spatial_resolution(spark, d):
    return introspect.spatial_resolution(cubes.cells(_ref(spark, d)))


@query("SELECT round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM (SELECT -80e0 + 20 * lat_idx AS lat, -170e0 + 20 * lon_idx AS lon FROM rm WHERE value > 25)")
def extents(spark, d):
    return reports.extents(cubes.cells(_means(spark, d)).withColumn("value", F.when(F.col("value") > 25, F.col("value"))))


# selections


@query("""SELECT lat_idx, CASE WHEN lo < -35 OR hi > 50 THEN (greatest(lo, -35) + least(hi, 50)) / 2 ELSE (lo + hi) / 2 END AS lat, greatest(lo, -35) AS lo, least(hi, 50) AS hi
FROM (SELECT DISTINCT lat_idx, -90e0 + 20 * lat_idx AS lo, -70e0 + 20 * lat_idx AS hi FROM r) WHERE hi > -35 AND lo < 50""")
def interval_sel_clip(spark, d):
    axis = cubes.cells(_ref(spark, d)).select("lat_idx", "lat", (F.col("lat") - 10).alias("lo"), (F.col("lat") + 10).alias("hi")).distinct()
    return transforms.interval_select(axis, -35.0, 50.0)


@query("""WITH v AS (SELECT DISTINCT lat_idx, -80 + 20 * lat_idx AS p FROM rm)
SELECT lat_idx, lon_idx, round(value, 6) AS value FROM rm JOIN v USING (lat_idx) WHERE p BETWEEN (SELECT p FROM v ORDER BY abs(p + 31), p DESC LIMIT 1) AND (SELECT p FROM v ORDER BY abs(p - 50), p DESC LIMIT 1)""")
def bbox_grid_nearest(spark, d):
    return regions.nearest_box(cubes.cells(_means(spark, d)), "lat", -31.0, 50.0).select(*CELL, "value")


@query(_IN_BOX + "SELECT region, count(*) AS sites, round(avg(value), 6) AS value FROM (SELECT site_id, lat, lon, avg(value) AS value FROM sites GROUP BY ALL) JOIN box ON lat BETWEEN es AND en AND lon BETWEEN ew AND ee GROUP BY ALL")
def bbox_sites(spark, d):
    held = regions.in_box(_site_means(spark, d), regions.boxes(spark))
    return held.groupBy("region").agg(F.count(F.lit(1)).alias("sites"), F.avg("value").alias("value"))


@query("SELECT lat_idx, lon_idx, round((com / 2 - ref) / nullif(ref, 0) * 100, 6) AS change FROM bias")
def expression_formula(spark, d):
    name, column, _, _ = formula("change = (com / 2 - ref) / ref * 100")
    return _bias(spark, d).select(*CELL, column.alias(name))


@query("SELECT lat_idx, lon_idx, (CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) AS lon, round(value, 6) AS value FROM (SELECT *, -170e0 + 20 * lon_idx AS lon FROM rm)")
def shift_lon(spark, d):
    return cubes.cells(_means(spark, d)).select(*CELL, align.to_positive_longitude(F.col("lon")).alias("lon"), "value")


@query("""WITH co AS (SELECT (l_suppkey % 6)::INT AS y, (l_partkey % 12)::INT AS x, year, month, avg(l_quantity) AS value FROM li WHERE l_linestatus = 'O' GROUP BY ALL),
com6 AS (SELECT y, x, sum(value * d) / sum(d) AS value FROM co JOIN days USING (month) GROUP BY ALL),
la AS (SELECT i, j FROM range(9) a(i), range(6) b(j) QUALIFY row_number() OVER (PARTITION BY i ORDER BY abs((-80 + 20 * i) - (-75 + 30 * j)), j DESC) = 1),
lo AS (SELECT i, j FROM range(18) a(i), range(12) b(j) QUALIFY row_number() OVER (PARTITION BY i ORDER BY abs((-170 + 20 * i) - (-165 + 30 * j)), j DESC) = 1)
SELECT la.i::INT AS lat_idx, lo.i::INT AS lon_idx, round(value, 6) AS value FROM com6 JOIN la ON la.j = y JOIN lo ON lo.j = x""")
def same_grid_nearest(spark, d):
    centres = lambda n, lo, hi: (align.edges(n, lo, hi)[1:] + align.edges(n, lo, hi)[:-1]) / 2
    lat = align.nearest_axis(spark, centres(9, -90, 90), centres(6, -90, 90), "lat")
    lon = align.nearest_axis(spark, centres(18, -180, 180), centres(12, -180, 180), "lon")
    return align.regrid_nearest(reduce.integrate(cubes.grid(spark, d, "O", 6, 12), CELL, days()), lat, lon)


@query("""SELECT lat_idx, lon_idx, round(CASE WHEN (lat_idx, lon_idx) IN (SELECT ((s_suppkey % 9)::INT, (s_nationkey % 18)::INT) FROM supplier WHERE s_nationkey % 4 = 1) THEN value END, 6) AS value FROM rm""")
def region_mask_raster(spark, d):
    supplier = spark.read.parquet(f"{d}/supplier.parquet")
    raster = supplier.select(F.concat(F.lit("n"), F.col("s_nationkey") % 4).alias("label"), (F.col("s_suppkey") % 9).cast("int").alias("lat_idx"), (F.col("s_nationkey") % 18).cast("int").alias("lon_idx"))
    known = regions.Regions()
    known.add_raster(raster, {f"n{k}": f"Nations {k}" for k in range(4)})
    return known.mask(_means(spark, d), "n1", trim=False)


@query(_IN_BOX + f"SELECT lat_idx, lon_idx, round(sum(en - es), 6) AS value FROM rm LEFT JOIN box ON {_HELD} GROUP BY ALL")
def quantile_map(spark, d):
    boxes = regions.boxes(spark)
    database = boxes.select(F.lit("da").alias("variable"), "region", F.lit(70).alias("quantile"), F.lit("bias").alias("type"), (F.col("north") - F.col("south")).alias("value"))
    return regions.quantile_map(cubes.cells(_means(spark, d)), boxes, database, "da", 70)


# windows


@query("SELECT year, round(sum(v) OVER (ORDER BY year), 6) AS value FROM (SELECT year, avg(value) AS v FROM sr GROUP BY year)")
def cumulative_flux(spark, d):
    return reduce.accumulate(resample.annual_mean(cubes.series(spark, d, "F"), []), [], ["year"], F.lit(1.0))


@query("SELECT lat_idx, lon_idx, year, month, round(value - first_value(value) OVER (PARTITION BY lat_idx, lon_idx ORDER BY year, month), 6) AS value FROM r")
def first_difference(spark, d):
    return _ref(spark, d).withColumn("value", transforms.first_difference(F.col("value"), CELL, ["year", "month"]))


# analyses and reports


@query("""SELECT lat_idx, lon_idx, round(u, 6) AS uncertainty, round(bias, 6) AS bias, round(exp(-greatest(abs(bias) - coalesce(u, 0e0), 0e0) / nullif(norm, 0)), 6) AS score
FROM (SELECT *, sqrt(pow(ref - ref * 0.99::DOUBLE, 2) + pow(ref - ref * 1.02::DOUBLE, 2)) AS u FROM bias)""")
def bias_uncertainty(spark, d):
    v = F.col("value")
    unsure = _means(spark, d).select(*CELL, scalar_uncertainty(v, v * 0.99, v * 1.02).alias("uncertainty"))
    return analyses.bias_with_uncertainty(_ref(spark, d), _com(spark, d), unsure, days()).select(*CELL, "uncertainty", "bias", "score")


@query("""WITH a AS (SELECT lat_idx, lon_idx, season, sum(value * d) / sum(d) AS ref FROM r JOIN seasons USING (month) GROUP BY ALL), b AS (SELECT lat_idx, lon_idx, season, sum(value * d) / sum(d) AS com FROM c JOIN seasons USING (month) GROUP BY ALL)
SELECT lat_idx, lon_idx, season, round(ref, 6) AS ref, round(com, 6) AS com, round(com - ref, 6) AS bias FROM a JOIN b USING (lat_idx, lon_idx, season)""")
def bias_seasonal(spark, d):
    return analyses.seasonal_bias(_ref(spark, d), _com(spark, d), CELL)


@query(_POINTS + """, n AS (SELECT least(24, greatest(0, floor((ind - il) / ((ih - il) / 25)))) AS bin, avg(dep) AS r, count(*) AS k FROM p, b GROUP BY bin),
m AS (SELECT least(24, greatest(0, floor((dep - il) / ((ih - il) / 25)))) AS bin, avg(ind) AS c, count(*) AS k FROM p, b GROUP BY bin),
j AS (SELECT r, c, n.k / (SELECT sum(k) FROM n)::DOUBLE >= 0.003::DOUBLE AND coalesce(m.k / (SELECT sum(k) FROM m)::DOUBLE >= 0.003::DOUBLE, false) AS held FROM n LEFT JOIN m USING (bin))
SELECT round(exp(-sqrt(sum(CASE WHEN held THEN (r - c) ** 2 ELSE r ** 2 END)) / sqrt(sum(r ** 2))), 6) AS score FROM j""")
def relationship_score(spark, d):
    points = _points(spark, d)
    return analyses.relationship_score(points, points.select(F.col("dep").alias("ind"), F.col("ind").alias("dep")))


def _scalars(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    name = F.concat(F.lit("Score "), F.col("l_linenumber"), F.lit(" [1]")).alias("name")
    return items.groupBy(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("region"), name).agg((F.avg("l_discount") * 10).alias("value")).withColumns({"type": F.lit("score"), "units": F.lit("1")})


_SCALARS = "s AS (SELECT l_returnflag AS source, l_linestatus AS region, 'Score ' || l_linenumber || ' [1]' AS name, avg(l_discount) * 10 AS value FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_SCALARS} SELECT source, region, name, round(value, 6) AS value, 'score' AS type, '1' AS units FROM s
UNION ALL SELECT source, region, 'Overall Score [1]', round(avg(value), 6), 'score', '1' FROM s GROUP BY source, region""", cte=False)
def overall_score(spark, d):
    return reduce.overall_score(_scalars(spark, d))


@query(f"""WITH {_SCALARS}, h AS (SELECT region, 'model' AS source, replace(name, ' [1]', '') AS name, value, unnest(['all', 'all::' || source, 'all::' || source || '!!' || name]) AS heading FROM s)
SELECT region, source, heading, name, round(avg(value), 6) AS value FROM h GROUP BY ALL""", cte=False)
def cmec_means(spark, d):
    named = _scalars(spark, d).select("region", F.lit("model").alias("source"), F.lit("all").alias("section"), F.col("source").alias("variable"), F.col("name").alias("dataset"), "name", "value")
    return reports.heading_means(named)


@query("""WITH m AS (SELECT unnest(['ref', 'bias', 'bias_score']) AS name, unnest([ref, bias, score]) AS value FROM bias), q AS (SELECT name, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM m GROUP BY name)
SELECT name, round(CASE name WHEN 'bias_score' THEN 0 WHEN 'bias' THEN -greatest(abs(lo), abs(hi)) ELSE lo END, 6) AS low, round(CASE name WHEN 'bias_score' THEN 1 WHEN 'bias' THEN greatest(abs(lo), abs(hi)) ELSE hi END, 6) AS high FROM q""")
def plot_limits(spark, d):
    maps = _bias(spark, d).select(F.stack(F.lit(3), F.lit("ref"), F.col("ref"), F.lit("bias"), F.col("bias"), F.lit("bias_score"), F.col("score")).alias("name", "value"))
    return reports.plot_limits(maps)


def runoff_sensitivity(spark, d):
    """Without SQL: least squares with confidence intervals."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    cell = [(F.col("l_suppkey") % 9).cast("int").alias("lat_idx"), (F.col("l_partkey") % 18).cast("int").alias("lon_idx"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")]
    cube = items.groupBy(*cell).agg(F.avg("l_quantity").alias("mrro"), F.avg("l_tax").alias("tas"), F.avg("l_extendedprice").alias("pr"))
    return rounded(runoff.sensitivity(cube.withColumn("basin", F.concat(F.lit("b"), F.col("lon_idx") % 3)), days(), cubes.area(), width=3))


_QUERIES["runoff_sensitivity"] = runoff_sensitivity


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
