"""Registered queries of the gridded operators and their SQL counterparts.

Final doubles are rounded to six places on both sides, since sums depend on
the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridloom.functions.measures import month_days, water_year
from gridloom.functions.units import conversion, convert
from gridloom.operators import align, analyses, reduce, regions, resample, transforms
from gridloom.plans import cubes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
CELL = ["lat_idx", "lon_idx"]


def days():
    return month_days(F.col("month"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema))


def query(sql: str, cte: bool = True):
    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        _SQL[f.__name__] = (_CTE + sql.strip().removeprefix("WITH")) if cte and sql.strip().startswith("WITH") else (_CTE.rstrip().rstrip(",") + "\n" + sql if cte else sql)
        return f

    return add


_CTE = """WITH days(month, d) AS (VALUES (1,31e0),(2,28e0),(3,31e0),(4,30e0),(5,31e0),(6,30e0),(7,31e0),(8,31e0),(9,30e0),(10,31e0),(11,30e0),(12,31e0)),
seasons(month, season) AS (VALUES (12,'DJF'),(1,'DJF'),(2,'DJF'),(3,'MAM'),(4,'MAM'),(5,'MAM'),(6,'JJA'),(7,'JJA'),(8,'JJA'),(9,'SON'),(10,'SON'),(11,'SON')),
li AS (SELECT *, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, (l_suppkey % 9)::INT AS lat_idx, (l_partkey % 18)::INT AS lon_idx FROM lineitem),
g AS (SELECT l_linestatus AS st, lat_idx, lon_idx, year, month, avg(l_quantity) AS value FROM li GROUP BY ALL),
r AS (SELECT lat_idx, lon_idx, year, month, value, d FROM g JOIN days USING (month) WHERE st = 'F'),
c AS (SELECT lat_idx, lon_idx, year, month, value, d FROM g JOIN days USING (month) WHERE st = 'O'),
lay AS (SELECT lat_idx, lon_idx, l_linenumber AS depth_idx, year, month, avg(l_quantity) AS value FROM li WHERE l_linestatus = 'F' GROUP BY ALL),
areas AS (SELECT i::INT AS lat_idx, 6.371e6 * 6.371e6 * radians(20e0) * (sin(radians(-90e0 + 20 * (i + 1))) - sin(radians(-90e0 + 20 * i))) / 1e12 AS a FROM range(9) t(i)),
rm AS (SELECT lat_idx, lon_idx, sum(value * d) / sum(d) AS value FROM r GROUP BY ALL),
cm AS (SELECT lat_idx, lon_idx, sum(value * d) / sum(d) AS value FROM c GROUP BY ALL),
rs AS (SELECT lat_idx, lon_idx, sqrt(sum(d * (r.value - rm.value) * (r.value - rm.value)) / sum(d)) AS norm FROM r JOIN rm USING (lat_idx, lon_idx) GROUP BY ALL),
bias AS (SELECT lat_idx, lon_idx, rm.value AS ref, norm, cm.value AS com, cm.value - rm.value AS bias, exp(-abs(cm.value - rm.value) / nullif(norm, 0)) AS score FROM rm JOIN rs USING (lat_idx, lon_idx) FULL JOIN cm USING (lat_idx, lon_idx)),
sr AS (SELECT year, month, sum(l_extendedprice) / 1e6 AS value, any_value(d) AS d FROM li JOIN days USING (month) WHERE l_linestatus = 'F' GROUP BY year, month),
sc AS (SELECT year, month, sum(l_extendedprice) / 1e6 AS value, any_value(d) AS d FROM li JOIN days USING (month) WHERE l_linestatus = 'O' GROUP BY year, month),
sites AS (SELECT c_nationkey AS site_id, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, avg(o_totalprice) AS value, -84e0 + 7 * c_nationkey AS lat, -168e0 + 14 * c_nationkey AS lon FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
"""


def _ref(spark, d):
    return cubes.grid(spark, d, "F")


def _com(spark, d):
    return cubes.grid(spark, d, "O")


def _bias(spark, d):
    return analyses.bias_maps(_ref(spark, d), _com(spark, d), days())


# measures and reductions


@query("SELECT lat_idx, round(a, 6) AS area FROM areas")
def cell_measures(spark, d):
    return _ref(spark, d).select("lat_idx").distinct().select("lat_idx", cubes.area().alias("area"))


@query("SELECT DISTINCT year, month, d AS days FROM r")
def time_measures(spark, d):
    return _ref(spark, d).select("year", "month", days().alias("days")).distinct()


@query("SELECT lat_idx, lon_idx, round(value, 6) AS value FROM rm")
def integrate_time_mean(spark, d):
    return reduce.integrate(_ref(spark, d), CELL, days())


@query("SELECT lat_idx, lon_idx, round(sum(value * d), 6) AS value FROM r GROUP BY ALL")
def integrate_time_sum(spark, d):
    return reduce.integrate(_ref(spark, d), CELL, days(), mean=False)


@query("SELECT lat_idx, lon_idx, year, month, round(sum(value * d) OVER (PARTITION BY lat_idx, lon_idx ORDER BY year, month), 6) AS value FROM r")
def accumulate_time(spark, d):
    return reduce.accumulate(_ref(spark, d), CELL, ["year", "month"], days())


@query("SELECT lat_idx, lon_idx, round(norm, 6) AS value FROM rs")
def std_time(spark, d):
    return reduce.weighted_std(_ref(spark, d), CELL, days())


@query("SELECT year, month, round(sum(value * a) / sum(a), 6) AS value FROM r JOIN areas USING (lat_idx) GROUP BY ALL")
def integrate_space_mean(spark, d):
    return reduce.integrate(_ref(spark, d), ["year", "month"], cubes.area())


@query("SELECT year, month, round(sum(value * a), 6) AS value FROM r JOIN areas USING (lat_idx) GROUP BY ALL")
def integrate_space_sum(spark, d):
    return reduce.integrate(_ref(spark, d), ["year", "month"], cubes.area(), mean=False)


@query("SELECT round(sum(score * a * ref) / sum(a * ref), 6) AS value FROM bias JOIN areas USING (lat_idx) WHERE score IS NOT NULL")
def integrate_space_weighted(spark, d):
    return reduce.integrate(_bias(spark, d).where(F.col("score").isNotNull()), [], cubes.area() * F.col("ref"), value="score").withColumnRenamed("score", "value")


def _thickness():
    """Layers that thicken downwards, in metres."""
    return F.lit(0.1) * F.col("depth_idx") * F.col("depth_idx")


@query("SELECT lat_idx, lon_idx, year, month, round(sum(value * 0.1::DOUBLE * depth_idx * depth_idx) / sum(0.1::DOUBLE * depth_idx * depth_idx), 6) AS value FROM lay GROUP BY ALL")
def integrate_depth_mean(spark, d):
    return reduce.integrate(cubes.grid(spark, d, "F", layered=True), [*CELL, "year", "month"], _thickness())


@query("SELECT lat_idx, lon_idx, year, month, round(sum(value * 0.1::DOUBLE * depth_idx * depth_idx), 6) AS value FROM lay GROUP BY ALL")
def integrate_depth_sum(spark, d):
    return reduce.integrate(cubes.grid(spark, d, "F", layered=True), [*CELL, "year", "month"], _thickness(), mean=False)


@query("SELECT (lat_idx // 3)::INT AS lat_idx, (lon_idx // 3)::INT AS lon_idx, year, month, round(sum(value * a) / sum(a), 6) AS value FROM r JOIN areas USING (lat_idx) GROUP BY lat_idx // 3, lon_idx // 3, year, month")
def coarsen_grid(spark, d):
    return reduce.coarsen(_ref(spark, d), 3, cubes.area(), ["year", "month"])


@query("SELECT lat_idx, lon_idx, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS quantile, round(unnest(quantile_cont(value, [0.1, 0.5, 0.9])), 6) AS value FROM r GROUP BY lat_idx, lon_idx")
def quantile_transform(spark, d):
    return reduce.quantiles(_ref(spark, d), CELL, [0.1, 0.5, 0.9])


# selections and expressions


@query("SELECT lat_idx, lon_idx, year, month, round(value, 6) AS value FROM r WHERE year BETWEEN 1996 AND 1998")
def select_time(spark, d):
    return transforms.select_range(_ref(spark, d), "year", 1996, 1998)


@query("SELECT lat_idx, lon_idx, depth_idx, year, month, round(value, 6) AS value FROM lay WHERE depth_idx = 4")
def select_depth_nearest(spark, d):
    return transforms.select_nearest(cubes.grid(spark, d, "F", layered=True), "depth_idx", 3.6)


@query("SELECT lat_idx, lon_idx, year, month, round(value, 6) AS value FROM r WHERE -80 + 20 * lat_idx BETWEEN -40 AND 40")
def select_lat_slice(spark, d):
    return transforms.select_range(cubes.cells(_ref(spark, d)), "lat", -40, 40).drop("lat", "lon")


@query("SELECT lat_idx, lon_idx, year, month, round(CASE WHEN NOT value < 20 THEN value END, 6) AS value FROM r")
def mask_condition(spark, d):
    return transforms.mask_where(_ref(spark, d), "lt", 20.0)


@query("SELECT lat_idx, lon_idx, round((com - ref) / nullif(ref, 0), 6) AS ratio FROM bias")
def expression_ratio(spark, d):
    return transforms.expression(_bias(spark, d), "ratio", "try_divide(com - ref, ref)").select(*CELL, "ratio")


@query("SELECT lat_idx, lon_idx, year, month, round(value, 6) AS quantity FROM r")
def rename_vars(spark, d):
    return _ref(spark, d).withColumnRenamed("value", "quantity")


@query("SELECT lat_idx, lon_idx, round(value * 86400, 6) AS mm_per_day, round(value * 86400 * 365.25 / 1000 / 0.9982071::DOUBLE, 6) AS m_per_year FROM rm")
def convert_units(spark, d):
    m = reduce.integrate(_ref(spark, d), CELL, days())
    return m.select(*CELL, (F.col("value") * conversion("kg m-2 s-1", "kg m-2 d-1")[0]).alias("mm_per_day"), convert(F.col("value"), "kg m-2 s-1", "m yr-1").alias("m_per_year"))


# resampling


@query("SELECT lat_idx, lon_idx, year, round(avg(value), 6) AS value FROM r GROUP BY ALL")
def annual_mean(spark, d):
    return resample.annual_mean(_ref(spark, d), CELL)


def _monthly_sql(rows: str) -> str:
    """All months from the first to the last of the rows for every user."""
    return f"""WITH e AS ({rows}), m AS (SELECT unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS mo FROM e),
v AS (SELECT user_id, date_trunc('month', ts) AS mo, avg(value) AS value FROM e GROUP BY ALL)
SELECT user_id, year(mo)::INT AS year, month(mo)::INT AS month, round(value, 6) AS value FROM (SELECT DISTINCT user_id FROM e) CROSS JOIN m LEFT JOIN v USING (user_id, mo)"""


@query(_monthly_sql("SELECT user_id, ts, value FROM events"), cte=False)
def monthly_mean(spark, d):
    return resample.monthly_mean(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "ts")


@query(_monthly_sql("SELECT c_nationkey AS user_id, o_orderdate AS ts, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE (year(o_orderdate) * 12 + month(o_orderdate)) % 5 < 3"), cte=False)
def monthly_mean_gaps(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).where((F.year("o_orderdate") * 12 + F.month("o_orderdate")) % 5 < 3)
    return resample.monthly_mean(rows.select(F.col("c_nationkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")), ["user_id"], "ts")


_SEASONAL = "SELECT lat_idx, lon_idx, season, year + (month = 12)::INT AS season_year, value, d, month FROM r JOIN seasons USING (month)"


@query(f"SELECT lat_idx, lon_idx, season, season_year, round(sum(value * d) / sum(d), 6) AS value FROM ({_SEASONAL}) GROUP BY ALL HAVING count(DISTINCT month) = 3")
def seasonal_mean(spark, d):
    return resample.seasonal_mean(_ref(spark, d), CELL)


@query(f"""SELECT lat_idx, lon_idx, season, round(sum(value * d) / sum(d), 6) AS value FROM ({_SEASONAL})
WHERE (lat_idx, lon_idx, season, season_year) IN (SELECT (lat_idx, lon_idx, season, season_year) FROM ({_SEASONAL}) GROUP BY lat_idx, lon_idx, season, season_year HAVING count(DISTINCT month) = 3) GROUP BY ALL""")
def seasonal_climatology(spark, d):
    return resample.seasonal_climatology(_ref(spark, d), CELL)


@query("SELECT lat_idx, lon_idx, month, round(avg(value), 6) AS value FROM r GROUP BY ALL")
def monthly_climatology(spark, d):
    return resample.monthly_climatology(_ref(spark, d), CELL)


@query("SELECT lat_idx, lon_idx, (CASE WHEN month > 9 THEN year ELSE year - 1 END)::INT AS water_year, round(sum(value * d) / sum(d), 6) AS value FROM r GROUP BY ALL")
def water_year_mean(spark, d):
    return resample.water_year_mean(_ref(spark, d), CELL)


def _daily_index(name: str, fold: str, test: str):
    @query(f"""SELECT user_id, year(day)::INT AS year, month(day)::INT AS month, sum(({test})::INT)::BIGINT AS days
FROM (SELECT user_id, ts::DATE AS day, {fold}(value) - 10 AS v FROM events GROUP BY ALL) GROUP BY ALL""", cte=False)
    def index(spark, d):
        how, condition = resample.DAILY_INDICES[name]
        # of the daily value, not of each: the mean of shifted values is rounded otherwise
        return resample.threshold_days(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "ts", how, lambda v: condition(v - 10))

    _QUERIES[f"count_{name}"], _SQL[f"count_{name}"] = _QUERIES.pop("index"), _SQL.pop("index")


_daily_index("wet_days", "avg", "v >= 1")
_daily_index("summer_days", "max", "v >= 25")
_daily_index("ice_days", "max", "v < 0")
_daily_index("tropical_nights", "min", "v > 20")
_daily_index("frost_days", "min", "v < 0")


@query("SELECT lat_idx, lon_idx, year, sum((value > 25)::INT)::DOUBLE AS value FROM r GROUP BY ALL")
def agg_time_sum(spark, d):
    return resample.on_condition(_ref(spark, d), [*CELL, "year"], F.col("value") > 25, "sum")


@query("SELECT lat_idx, lon_idx, year, round(avg((value > 25)::INT), 6) AS value FROM r GROUP BY ALL")
def agg_time_mean(spark, d):
    return resample.on_condition(_ref(spark, d), [*CELL, "year"], F.col("value") > 25, "mean")


# alignment


@query("SELECT lat_idx, lon_idx, year, month, round(value, 6) AS value FROM r WHERE (year, month) IN (SELECT (year, month) FROM c WHERE lat_idx = 0)")
def trim_time(spark, d):
    return align.trim_time(_ref(spark, d), _com(spark, d).where("lat_idx = 0"))[0]


@query("SELECT lat_idx, lon_idx, (CASE WHEN 10 + 20 * lon_idx >= 180 THEN 10 + 20 * lon_idx - 360 ELSE 10 + 20 * lon_idx END)::DOUBLE AS lon, round(value, 6) AS value FROM rm")
def adjust_lon(spark, d):
    m = reduce.integrate(_ref(spark, d), CELL, days())
    return m.select(*CELL, align.to_signed_longitude(10.0 + 20.0 * F.col("lon_idx")).alias("lon"), "value")


def _nested(spark, d):
    lat = align.nested_axis(spark, align.edges(9, -90, 90), align.edges(6, -90, 90), "lat")
    lon = align.nested_axis(spark, align.edges(18, -180, 180), align.edges(12, -180, 180), "lon")
    com = reduce.integrate(cubes.grid(spark, d, "O", 6, 12), CELL, days())
    return align.nest(reduce.integrate(_ref(spark, d), CELL, days()), com, lat, lon)


_NESTED = """WITH co AS (SELECT (l_suppkey % 6)::INT AS y, (l_partkey % 12)::INT AS x, year, month, avg(l_quantity) AS value FROM li WHERE l_linestatus = 'O' GROUP BY ALL),
com6 AS (SELECT y, x, sum(value * d) / sum(d) AS value FROM co JOIN days USING (month) GROUP BY ALL),
yb AS (SELECT DISTINCT b FROM (SELECT -90e0 + 20 * i AS b FROM range(10) t(i) UNION ALL SELECT -90e0 + 30 * i FROM range(7) t(i))),
xb AS (SELECT DISTINCT b FROM (SELECT -180e0 + 20 * i AS b FROM range(19) t(i) UNION ALL SELECT -180e0 + 30 * i FROM range(13) t(i))),
ya AS (SELECT lo, hi, floor(((lo + hi) / 2 + 90) / 20)::INT AS ya, floor(((lo + hi) / 2 + 90) / 30)::INT AS yb FROM (SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM yb) WHERE hi IS NOT NULL),
xa AS (SELECT lo AS xlo, hi AS xhi, floor(((lo + hi) / 2 + 180) / 20)::INT AS xa, floor(((lo + hi) / 2 + 180) / 30)::INT AS xb FROM (SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM xb) WHERE hi IS NOT NULL),
nested AS (SELECT ya.lo AS lat_lo, ya.hi AS lat_hi, xlo AS lon_lo, xhi AS lon_hi, rm.value AS ref, com6.value AS com FROM ya CROSS JOIN xa LEFT JOIN rm ON rm.lat_idx = ya AND rm.lon_idx = xa LEFT JOIN com6 ON com6.y = ya.yb AND com6.x = xa.xb)
"""


@query(_NESTED + "SELECT lat_lo, lat_hi, lon_lo, lon_hi, round(ref, 6) AS ref, round(com, 6) AS com FROM nested")
def nest_grids(spark, d):
    return _nested(spark, d).select("lat_lo", "lat_hi", "lon_lo", "lon_hi", "ref", "com")


_NEST_AREA = "(radians(lon_hi - lon_lo) * (sin(radians(lat_hi)) - sin(radians(lat_lo))))"


@query(_NESTED + f"SELECT round(sum(ref * {_NEST_AREA}), 6) AS nested, round((SELECT sum(value * a * 1e12 / (6.371e6 * 6.371e6)) FROM rm JOIN areas USING (lat_idx)), 6) AS before FROM nested")
def nest_conservation(spark, d):
    from gridloom.functions.measures import EARTH_RADIUS, band_height

    n = _nested(spark, d).agg(F.sum(F.col("ref") * F.radians(F.col("lon_hi") - F.col("lon_lo")) * band_height(F.col("lat_lo"), F.col("lat_hi"))).alias("nested"))
    before = reduce.integrate(reduce.integrate(_ref(spark, d), CELL, days()), [], cubes.area() * 1e12 / EARTH_RADIUS**2, mean=False)
    return n.join(before.withColumnRenamed("value", "before"), F.lit(True))


@query(_NESTED + f"SELECT round(sum((com - ref) * {_NEST_AREA}) / sum({_NEST_AREA}), 6) AS value FROM nested WHERE com IS NOT NULL AND ref IS NOT NULL")
def aligned_diff(spark, d):
    from gridloom.functions.measures import band_height

    area = F.radians(F.col("lon_hi") - F.col("lon_lo")) * band_height(F.col("lat_lo"), F.col("lat_hi"))
    return reduce.integrate(_nested(spark, d).withColumn("value", F.col("com") - F.col("ref")), [], area)


# sites


def _site_means(spark, d):
    return cubes.sites(spark, d).groupBy("site_id", "lat", "lon").agg(F.avg("value").alias("value"))


def _pairs(spark, d, circle: bool, width: float = 25.0):
    source = cubes.cells(reduce.integrate(_ref(spark, d), CELL, days())).select((F.col("lat_idx") * 18 + F.col("lon_idx")).alias("id"), "lat", "lon", "value")
    return align.neighbours(_site_means(spark, d).select("site_id", "lat", "lon"), source, width, circle)


_PAIRS = """WITH s AS (SELECT DISTINCT site_id, lat, lon FROM sites), o AS (SELECT lat_idx * 18 + lon_idx AS id, -80e0 + 20 * lat_idx AS lat, -170e0 + 20 * lon_idx AS lon, value FROM rm),
p AS (SELECT s.site_id, o.id, o.value, sqrt((o.lat - s.lat) * (o.lat - s.lat) + (o.lon - s.lon) * (o.lon - s.lon)) AS dist, abs(o.lat - s.lat) AS dy, abs(o.lon - s.lon) AS dx FROM s, o)
"""


@query(_PAIRS + "SELECT site_id, count(*) AS n FROM p WHERE dist <= 25 GROUP BY ALL")
def neighbors_circle(spark, d):
    return _pairs(spark, d, True).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))


@query(_PAIRS + "SELECT site_id, count(*) AS n FROM p WHERE dy <= 25 AND dx <= 25 GROUP BY ALL")
def neighbors_box(spark, d):
    return _pairs(spark, d, False).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))


def _site_list(spark, d):
    return _site_means(spark, d).select("site_id", "lat", "lon")


_NEAREST = "SELECT s.site_id, round(v, 6) AS value, round(dist, 6) AS distance FROM s LEFT JOIN (SELECT site_id, arg_min(value, dist * 100000 + id) AS v, min(dist) AS dist FROM p WHERE value IS NOT NULL AND {} GROUP BY ALL) USING (site_id)"


@query(_PAIRS + _NEAREST.format("dist <= 25"))
def closest_site(spark, d):
    return align.closest(_pairs(spark, d, True), _site_list(spark, d), "site_id", "value")


_GAPS = _PAIRS.replace("-170e0 + 20 * lon_idx AS lon, value FROM rm", "-170e0 + 20 * lon_idx AS lon, CASE WHEN (lat_idx + lon_idx) % 3 = 0 THEN value END AS value FROM rm")


def _gappy_pairs(spark, d):
    """Two of three cells miss their values, and sites reach 12 degrees only."""
    pairs = _pairs(spark, d, True, 12.0)
    return pairs.withColumn("src_value", F.when((F.floor(F.col("src_id") / 18) + F.col("src_id") % 18) % 3 == 0, F.col("src_value")))


@query(_GAPS + _NEAREST.format("dist <= 12"))
def closest_site_gaps(spark, d):
    return align.closest(_gappy_pairs(spark, d), _site_list(spark, d), "site_id", "value")


_HOOD_MEAN = """, h AS (SELECT site_id, value AS v, {} AS w FROM p WHERE {} AND value IS NOT NULL), m AS (SELECT site_id, sum(v * w) / sum(w) AS m FROM h GROUP BY ALL),
k AS (SELECT site_id, any_value(m) AS value, sqrt(sum(w * (v - m) ** 2) / sum(w)) AS std FROM h JOIN m USING (site_id) GROUP BY ALL)
SELECT s.site_id, round(value, 6) AS value, round(std, 6) AS std FROM s LEFT JOIN k USING (site_id)"""


@query(_PAIRS + _HOOD_MEAN.format("1e0", "dist <= 25"))
def neighborhood_mean(spark, d):
    return align.neighbourhood_mean(_pairs(spark, d, True), _site_list(spark, d), "site_id", "value")


@query(_PAIRS + _HOOD_MEAN.format("1 / greatest(dist, 0.1::DOUBLE)", "dist <= 25"))
def neighborhood_weighted_mean(spark, d):
    return align.neighbourhood_mean(_pairs(spark, d, True), _site_list(spark, d), "site_id", "value", weighted=True)


@query(_GAPS + _HOOD_MEAN.format("1e0", "dist <= 12"))
def neighborhood_mean_gaps(spark, d):
    return align.neighbourhood_mean(_gappy_pairs(spark, d), _site_list(spark, d), "site_id", "value")


@query(_PAIRS + _NEAREST.format("dist <= 25 AND id % 4 = site_id % 4"))
def match_label(spark, d):
    pairs = _pairs(spark, d, True).withColumns({"cover": F.col("site_id") % 4, "src_cover": F.col("src_id") % 4})
    return align.closest(align.match_label(pairs, "cover"), _site_list(spark, d), "site_id", "value")


@query(_PAIRS + "SELECT s.site_id, round(v, 6) AS value FROM s LEFT JOIN (SELECT site_id, sum(value / greatest(dist, 0.1::DOUBLE)) / sum(1 / greatest(dist, 0.1::DOUBLE)) AS v FROM p WHERE dy <= 15 AND dx <= 15 AND id % 4 = site_id % 4 GROUP BY ALL) USING (site_id)")
def extract_sites(spark, d):
    sources = cubes.cells(reduce.integrate(_ref(spark, d), CELL, days())).select((F.col("lat_idx") * 18 + F.col("lon_idx")).alias("id"), "lat", "lon", "value")
    sites = _site_list(spark, d).withColumn("cover", F.col("site_id") % 4)
    return align.extract_sites(sites, sources.withColumn("cover", F.col("id") % 4), "weighted_mean", 15.0, circle=False, label="cover")


# regions


_BOXES = ", ".join(f"('{k}', {s}::DOUBLE, {n}::DOUBLE, {w}::DOUBLE, {e}::DOUBLE)" for k, _, s, n, w, e in regions.BOXES)
#: The points of a grid nearest to both edges of a box hold its cells; ties go to the larger coordinate.
_NEAR = "(SELECT p FROM (SELECT {} AS p FROM range({}) t(i)) ORDER BY abs(p - {}), p DESC LIMIT 1)"
_LAT, _LON = ("-80e0 + 20 * i", 9), ("-170e0 + 20 * i", 18)
_IN_BOX = f"""WITH edges(region, es, en, ew, ee) AS (VALUES {_BOXES}),
box AS (SELECT region, es, en, ew, ee, {_NEAR.format(*_LAT, "es")} AS s, {_NEAR.format(*_LAT, "en")} AS n, {_NEAR.format(*_LON, "ew")} AS w, {_NEAR.format(*_LON, "ee")} AS e FROM edges)
"""
_HELD = "-80 + 20 * lat_idx BETWEEN s AND n AND -170 + 20 * lon_idx BETWEEN w AND e"


@query(_IN_BOX + f"SELECT lat_idx, lon_idx, round(CASE WHEN {_HELD} THEN value END, 6) AS value FROM rm, box WHERE region = 'tena'")
def region_mask_untrimmed(spark, d):
    cells = cubes.cells(reduce.integrate(_ref(spark, d), CELL, days()))
    return regions.Regions().mask(cells, "tena", trim=False).select(*CELL, "value")


@query(_IN_BOX + f"SELECT region, round(sum(value * a) / sum(a), 6) AS value, count(*) AS cells FROM rm JOIN areas USING (lat_idx) JOIN box ON {_HELD} GROUP BY ALL")
def region_mask_box(spark, d):
    held = regions.in_box(cubes.cells(reduce.integrate(_ref(spark, d), CELL, days())), regions.boxes(spark))
    from gridloom.functions.measures import weighted_mean

    return held.groupBy("region").agg(weighted_mean(F.col("value"), cubes.area()).alias("value"), F.count(F.lit(1)).alias("cells"))


@query(_IN_BOX + f"SELECT lat_idx, lon_idx, sum(ascii(region) * 1e0) AS value FROM rm LEFT JOIN box ON {_HELD} GROUP BY ALL")
def region_scalars_map(spark, d):
    scalars = regions.boxes(spark).select("region", F.ascii("region").cast("double").alias("scalar"))
    return regions.scalars_to_map(cubes.cells(reduce.integrate(_ref(spark, d), CELL, days())), regions.boxes(spark), scalars)


# windows


@query("""WITH wy AS (SELECT lat_idx, lon_idx, (CASE WHEN month > 9 THEN year ELSE year - 1 END)::INT AS water_year, sum(value * d) / sum(d) AS v FROM r GROUP BY ALL)
SELECT lat_idx, lon_idx, water_year, round(CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END, 6) AS value FROM wy WINDOW w AS (PARTITION BY lat_idx, lon_idx ORDER BY water_year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def rolling_water_year(spark, d):
    return resample.water_year_mean(_ref(spark, d), CELL).withColumn("value", transforms.centred_mean(F.col("value"), CELL, "water_year", 3))


@query("SELECT lat_idx, lon_idx, year, month, round(100 * (value - avg(value) OVER w) / avg(value) OVER w, 6) AS value FROM r WINDOW w AS (PARTITION BY lat_idx, lon_idx)")
def anomaly_percent(spark, d):
    return _ref(spark, d).withColumn("value", transforms.anomaly_percent(F.col("value"), CELL))


@query("SELECT lat_idx, lon_idx, round(regr_slope(value, depth_idx - 0.5::DOUBLE), 6) AS slope FROM (SELECT lat_idx, lon_idx, depth_idx, sum(value * d) / sum(d) AS value FROM lay JOIN days USING (month) GROUP BY ALL) GROUP BY ALL")
def depth_gradient(spark, d):
    m = reduce.integrate(cubes.grid(spark, d, "F", layered=True), [*CELL, "depth_idx"], days())
    return transforms.depth_gradient(m.withColumn("depth", F.col("depth_idx") - 0.5), CELL)


_FROZEN = """WITH y AS (SELECT lat_idx, lon_idx, depth_idx, year, coalesce(max(value) < 45, false) AS frozen FROM lay WHERE depth_idx - 0.5 < 3.5 GROUP BY ALL),
t AS (SELECT a.*, a.frozen AND coalesce(b.frozen, false) AS twice FROM y a LEFT JOIN y b ON a.lat_idx = b.lat_idx AND a.lon_idx = b.lon_idx AND a.depth_idx = b.depth_idx AND b.year = (SELECT min(year) FROM lay WHERE year > a.year)),
k AS (SELECT lat_idx, lon_idx, year, bool_or(twice) AS extent, sum(CASE WHEN frozen THEN 1e0 ELSE 0e0 END) AS hard FROM t GROUP BY ALL)
"""


def _soil(spark, d):
    return cubes.grid(spark, d, "F", layered=True).withColumn("dz", F.lit(1.0)).withColumnRenamed("depth_idx", "depth")


@query(_FROZEN + "SELECT lat_idx, lon_idx, CASE WHEN bool_or(extent) THEN 1e0 END AS extent FROM k GROUP BY ALL")
def permafrost_extent(spark, d):
    return transforms.permafrost(_soil(spark, d), CELL, 45.0)


@query(_FROZEN + "SELECT lat_idx, lon_idx, year, extent, CASE WHEN extent THEN 3 - hard END AS active FROM k")
def active_layer_thickness(spark, d):
    return transforms.frozen_ground(_soil(spark, d), CELL, 45.0)


@query("SELECT lat_idx, lon_idx, depth_idx, year, month, round(value / 0.1::DOUBLE / 998.2071::DOUBLE, 6) AS value FROM lay WHERE depth_idx = 1")
def soil_moisture(spark, d):
    top = cubes.grid(spark, d, "F", layered=True).where("depth_idx = 1")
    return top.withColumn("value", transforms.volume_fraction(F.col("value"), F.lit(0.1)))


@query("""WITH m AS (SELECT year, month, sum(value * a) * 3991.868::DOUBLE * 1026e0 / 1e12 AS heat FROM r JOIN areas USING (lat_idx) GROUP BY ALL)
SELECT year, round(avg(heat - (SELECT arg_min(heat, year * 12 + month) FROM m)), 6) AS value FROM m GROUP BY ALL""")
def ocean_heat(spark, d):
    return transforms.ocean_heat(_ref(spark, d), cubes.area() / 1e12)


@query("SELECT year, month, round(max(value), 6) AS value FROM lay WHERE lon_idx = 0 AND lat_idx = (SELECT i FROM range(9) t(i) ORDER BY abs(-80 + 20 * i - 26.5), i DESC LIMIT 1) GROUP BY ALL")
def amoc_max(spark, d):
    return transforms.overturning_maximum(cubes.cells(cubes.grid(spark, d, "F", layered=True)).withColumn("basin", F.col("lon_idx")), 0)


# analyses


@query("""SELECT round(sum(ref * a) / sum(CASE WHEN ref IS NOT NULL THEN a END), 6) AS ref_mean, round(sum(com * a) / sum(CASE WHEN com IS NOT NULL THEN a END), 6) AS com_mean,
round(sum(bias * a) / sum(CASE WHEN bias IS NOT NULL THEN a END), 6) AS bias, round(sum(score * a) / sum(CASE WHEN score IS NOT NULL THEN a END), 6) AS score, count(score) AS n FROM bias JOIN areas USING (lat_idx)""")
def bias_collier(spark, d):
    from gridloom.functions.measures import weighted_mean

    names = {"ref": "ref_mean", "com": "com_mean", "bias": "bias", "score": "score"}
    return _bias(spark, d).agg(*(weighted_mean(F.col(c), cubes.area()).alias(n) for c, n in names.items()), F.count("score").alias("n"))


@query("""SELECT lat_idx, lon_idx, round(a.value, 6) AS ref, round(a.value, 6) AS norm, round(cm.value, 6) AS com, round(cm.value - a.value, 6) AS bias, round(exp(-abs(cm.value - a.value) / abs(nullif(a.value, 0))), 6) AS score
FROM (SELECT * FROM r WHERE year = 1995 AND month = 2) a FULL JOIN cm USING (lat_idx, lon_idx)""")
def bias_single_step(spark, d):
    return analyses.bias_maps(_ref(spark, d).where("year = 1995 and month = 2"), _com(spark, d), days())


@query("SELECT lat_idx, lon_idx, round(ref, 6) AS ref, round(norm, 6) AS norm, round(com, 6) AS com, round(bias, 6) AS bias, round(score, 6) AS score FROM bias")
def bias_maps(spark, d):
    return _bias(spark, d)


@query("SELECT lat_idx, lon_idx, round(greatest(0e0, least(1e0, 1 - greatest(abs(bias) - 0.05::DOUBLE, 0e0) / (2 + lat_idx))), 6) AS score FROM bias WHERE bias IS NOT NULL")
def bias_quantiles(spark, d):
    b = _bias(spark, d).where(F.col("bias").isNotNull())
    return b.select(*CELL, analyses.quantile_bias_score(F.col("bias"), F.lit(0.05), F.col("lat_idx") + 2.0).alias("score"))


@query("""WITH p AS (SELECT lat_idx, lon_idx, d, r.value AS rv, c.value AS cv FROM r JOIN c USING (lat_idx, lon_idx, year, month, d)),
m AS (SELECT lat_idx, lon_idx, sum(rv * d) / sum(d) AS mr, sum(cv * d) / sum(d) AS mc FROM p GROUP BY ALL)
SELECT lat_idx, lon_idx, round(sqrt(sum(d * (cv - rv) ** 2) / sum(d)), 6) AS rmse, round(sqrt(sum(d * ((cv - mc) - (rv - mr)) ** 2) / sum(d)), 6) AS crmse, round(sqrt(sum(d * (rv - mr) ** 2) / sum(d)), 6) AS crms,
round(exp(-sqrt(sum(d * ((cv - mc) - (rv - mr)) ** 2) / sum(d)) / nullif(sqrt(sum(d * (rv - mr) ** 2) / sum(d)), 0)), 6) AS score FROM p JOIN m USING (lat_idx, lon_idx) GROUP BY ALL""")
def rmse(spark, d):
    return analyses.rmse_maps(_ref(spark, d), _com(spark, d), days())


_CYCLE = """WITH y AS (SELECT st, lat_idx, lon_idx, year, max(value) - min(value) AS a FROM g GROUP BY ALL), amp AS (SELECT st, lat_idx, lon_idx, avg(a) AS amp, stddev_pop(a) AS amp_std FROM y GROUP BY ALL),
mo AS (SELECT st, lat_idx, lon_idx, month, avg(value) AS v FROM g GROUP BY ALL), top AS (SELECT st, lat_idx, lon_idx, (month - 1)::INT AS tmax FROM mo QUALIFY row_number() OVER (PARTITION BY st, lat_idx, lon_idx ORDER BY v DESC, month) = 1)
"""


@query(_CYCLE + "SELECT lat_idx, lon_idx, round(amp, 6) AS amp, round(amp_std, 6) AS amp_std, tmax FROM amp JOIN top USING (st, lat_idx, lon_idx) WHERE st = 'F'")
def cycle_maps(spark, d):
    return analyses.cycle_maps(_ref(spark, d))


@query(_CYCLE + "SELECT lat_idx, lon_idx, CASE WHEN lat_idx > 0 THEN round(amp, 6) END AS amp, CASE WHEN lat_idx > 0 THEN round(amp_std, 6) END AS amp_std, CASE WHEN lat_idx > 0 THEN tmax END AS tmax FROM amp JOIN top USING (st, lat_idx, lon_idx) WHERE st = 'F'")
def cycle_without_values(spark, d):
    return analyses.cycle_maps(_ref(spark, d).withColumn("value", F.when(F.col("lat_idx") > 0, F.col("value"))))


@query(_CYCLE + """, s AS (SELECT f.lat_idx, f.lon_idx, o.tmax - f.tmax AS d FROM top f JOIN top o ON f.lat_idx = o.lat_idx AND f.lon_idx = o.lon_idx AND f.st = 'F' AND o.st = 'O'),
w AS (SELECT lat_idx, lon_idx, (CASE WHEN d > 6 THEN d - 12 WHEN d < -6 THEN d + 12 ELSE d END)::INT AS shift FROM s)
SELECT lat_idx, lon_idx, shift, round(1 - abs(shift) / 6e0, 6) AS score FROM w""")
def cycle_score(spark, d):
    both = analyses.cycle_maps(_ref(spark, d)).select(*CELL, F.col("tmax").alias("r")).join(analyses.cycle_maps(_com(spark, d)).select(*CELL, F.col("tmax").alias("c")), CELL)
    shift, score = analyses.shift_score(F.col("r"), F.col("c"))
    return both.select(*CELL, shift.alias("shift"), score.alias("score"))


@query(_IN_BOX + f"""SELECT region, round(sc / sr, 6) AS std, round(k, 6) AS corr, round(4 * (1 + k) / ((sc / sr + sr / sc) ** 2 * 2), 6) AS score
FROM (SELECT region, stddev_pop(ref) AS sr, stddev_pop(com) AS sc, corr(ref, com) AS k FROM bias JOIN box ON {_HELD} GROUP BY region HAVING stddev_pop(ref) > 1e-12)""")
def spatial_distribution(spark, d):
    held = regions.in_box(cubes.cells(_bias(spark, d)), regions.boxes(spark))
    return analyses.spatial_distribution(held, ["region"])


def _points(spark, d):
    return _ref(spark, d).select(*CELL, "year", "month", F.col("value").alias("ind")).join(_com(spark, d).select(*CELL, "year", "month", F.col("value").alias("dep")), [*CELL, "year", "month"])


_POINTS = """WITH p AS (SELECT r.value AS ind, c.value AS dep FROM r JOIN c USING (lat_idx, lon_idx, year, month)), b AS (SELECT min(ind) AS il, max(ind) AS ih, min(dep) AS dl, max(dep) AS dh FROM p)
"""


@query(_POINTS + """, n AS (SELECT least(24, greatest(0, floor((ind - il) / ((ih - il) / 25))))::INT AS bin, dep FROM p, b), k AS (SELECT bin, count(*) AS points, avg(dep) AS mean, stddev_pop(dep) AS std FROM n GROUP BY ALL)
SELECT bin, points, round(mean, 6) AS mean, round(std, 6) AS std FROM k WHERE points / (SELECT sum(points) FROM k)::DOUBLE >= 0.003::DOUBLE""")
def relationship_response(spark, d):
    return analyses.relationship(_points(spark, d), [])


@query(_POINTS + """, n AS (SELECT least(24, floor((ind - il) / ((ih - il) / 25)))::INT AS ind_bin, least(24, floor((dep - dl) / ((dh - dl) / 25)))::INT AS dep_bin FROM p, b)
SELECT ind_bin, dep_bin, round(count(*) / (SELECT count(*) FROM p)::DOUBLE, 6) AS share FROM n GROUP BY ALL""")
def relationship_hist(spark, d):
    return analyses.histogram2d(_points(spark, d))


_HELL = """WITH q AS (SELECT min(value) AS lo, max(value) AS hi FROM g),
h AS (SELECT st, lat_idx, lon_idx, bin, count(*) / sum(count(*)) OVER (PARTITION BY st, lat_idx, lon_idx)::DOUBLE AS p FROM (SELECT g.*, least(24, floor((value - lo) / ((hi - lo) / 25)))::INT AS bin FROM g, q) GROUP BY st, lat_idx, lon_idx, bin),
u AS (SELECT lat_idx, lon_idx, bin, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT * FROM h WHERE st = 'F') a FULL JOIN (SELECT * FROM h WHERE st = 'O') b USING (lat_idx, lon_idx, bin))
"""


@query(_HELL + "SELECT lat_idx, lon_idx, round(1 - sqrt(sum((sqrt(p) - sqrt(q)) ** 2)) / sqrt(2e0), 6) AS score FROM u GROUP BY ALL")
def dispersion_hellinger(spark, d):
    return analyses.hellinger(_ref(spark, d), _com(spark, d), CELL)


@query("""WITH t AS (SELECT d, sr.value AS r, sc.value AS c FROM sr JOIN sc USING (year, month, d)), m AS (SELECT sum(r * d) / sum(d) AS mr, sum(c * d) / sum(d) AS mc FROM t),
s AS (SELECT any_value(mr) AS mr, any_value(mc) AS mc, sqrt(sum(d * (c - mc) ** 2) / sum(d)) / sqrt(sum(d * (r - mr) ** 2) / sum(d)) AS std, corr(r, c) AS corr FROM t, m)
SELECT round(mr, 6) AS ref_mean, round(mc, 6) AS com_mean, round(std, 6) AS std, round(corr, 6) AS corr, round(exp(-abs((mc - mr) / mr)), 6) AS bias_score, round(4 * (1 + corr) / ((std + 1 / std) ** 2 * 2), 6) AS taylor_score FROM s""")
def timeseries_taylor(spark, d):
    return analyses.timeseries_scores(cubes.series(spark, d, "F"), cubes.series(spark, d, "O"), days())


@query("""WITH a AS (SELECT year, avg(value) AS flux FROM sr GROUP BY year), b AS (SELECT year, avg(value) AS flux FROM sc GROUP BY year),
x AS (SELECT a.year, a.flux AS f, b.flux AS g, sum(a.flux) OVER w AS r, sum(a.flux * 0.9::DOUBLE) OVER w AS lo, sum(a.flux * 1.2::DOUBLE) OVER w AS hi, sum(b.flux) OVER w AS c FROM a JOIN b USING (year) WINDOW w AS (ORDER BY a.year)), z AS (SELECT *, (hi - lo) / 2 AS u FROM x)
SELECT round(max(CASE WHEN year = 2000 THEN exp(-ln(2e0) * abs(g - f) / CASE WHEN u < 1e-8 THEN abs(f) ELSE u END) END), 6) AS difference_score, round(avg(exp(-(greatest(c - lo, 0e0) + greatest(hi - c, 0e0)) / u)), 6) AS trajectory_score FROM z""")
def nbp_scores(spark, d):
    ref = resample.annual_mean(cubes.series(spark, d, "F"), []).withColumn("lo", F.col("value") * 0.9).withColumn("hi", F.col("value") * 1.2)
    return analyses.balance_scores(ref, resample.annual_mean(cubes.series(spark, d, "O"), []), 2000)


@query("""WITH h AS (SELECT lat_idx, lon_idx, a, ref > 25 AS x, com > 25 AS y FROM bias JOIN areas USING (lat_idx)), t AS (SELECT sum(CASE WHEN x AND y THEN a ELSE 0 END) AS o, sum(CASE WHEN x AND NOT y THEN a ELSE 0 END) AS m, sum(CASE WHEN NOT x AND y THEN a ELSE 0 END) AS e FROM h)
SELECT round(o, 6) AS overlap, round(m, 6) AS missed, round(e, 6) AS excess, round(o / (o + m), 6) AS missed_score, round(o / (o + e), 6) AS excess_score FROM t""")
def area_overlap(spark, d):
    held = lambda s: reduce.integrate(cubes.grid(spark, d, s), CELL, days()).select(*CELL, (F.col("value") > 25).alias("held"))
    return analyses.area_overlap(held("F"), held("O"), cubes.area())


_HYDRO = """WITH hm AS (SELECT st, lat_idx, lon_idx, 'annual' AS period, avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT st, lat_idx, lon_idx, year, avg(value) AS v FROM g GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT st, lat_idx, lon_idx, season, avg(value), stddev_pop(value) FROM g JOIN seasons USING (month) GROUP BY ALL)
"""


@query(_HYDRO + "SELECT lat_idx, lon_idx, period, round(mean, 6) AS mean, round(std, 6) AS std FROM hm WHERE st = 'F'")
def hydro_metrics(spark, d):
    return analyses.hydro_metrics(_ref(spark, d)).select(*CELL, "period", "mean", "std")


@query(_HYDRO + "SELECT lat_idx, lon_idx, period, round(exp(-abs(c.mean - r.mean) / nullif(r.std, 0)), 6) AS score FROM (SELECT * FROM hm WHERE st = 'F') r JOIN (SELECT * FROM hm WHERE st = 'O') c USING (lat_idx, lon_idx, period)")
def hydro_scores(spark, d):
    return analyses.hydro_scores(_ref(spark, d), _com(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
