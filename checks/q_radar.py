"""Checks: radar images, composite, station windows, extrapolation and the causal join."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions import geo
from gaugeflow.functions.rain import reflectivity_to_rain as z_to_r
from gaugeflow.operators import radar
from gaugeflow.operators.halo import Slices

from .proxies import RADAR, SLICES
from .registry import query

STAT_DBL = "radar_r_pix " + " ".join(f"radar_r_mean{k} radar_r_max{k} radar_wetfrac{k}" for k in (3, 5, 7)) + " radar_nodata7"


@query("reflectivity_to_rain", "SELECT * FROM px", dbl="rain")
def reflectivity_to_rain(p):
    px = p.images.select("scan", F.col("site").alias("site"), F.posexplode("raw").alias("i", "v"))
    return px.select("scan", "site", F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).alias("col"), z_to_r(F.col("v")).alias("rain"))


GNOM = """
SELECT station_id, 519-CAST(floor((y+260)/1.0) AS BIGINT) AS row, CAST(floor((x+260)/1.0) AS BIGINT) AS col FROM (
 SELECT station_id, 6378.137*cos(f)*sin(dl)/c AS x, 6378.137*(cos(f0)*sin(f)-sin(f0)*cos(f)*cos(dl))/c AS y FROM (
  SELECT *, sin(f0)*sin(f)+cos(f0)*cos(f)*cos(dl) AS c FROM (SELECT station_id, radians(lat) AS f, radians(56.1) AS f0, radians(lon-10.6) AS dl FROM stations)))"""


@query("gnomonic_pixel_index", f"SELECT *, row BETWEEN 2 AND 517 AND col BETWEEN 2 AND 517 AS inside FROM ({GNOM})")
def gnomonic_pixel_index(p):
    return p.stations.select("station_id", *[c.alias(n) for n, c in geo.gnomonic_pixel(F.col("lon"), F.col("lat")).items()])


@query("nearest_site_composite", "SELECT * FROM comp", dbl="rain")
def nearest_site_composite(p):
    return p.build_comp()


@query("composite_from_images", "SELECT * FROM comp", dbl="rain")
def composite_from_images(p):
    return radar.composite_from_images(p.images, p.cell_map, p.shape)


@query("pixel_window_stats", "SELECT * FROM scanstat", dbl=STAT_DBL)
def pixel_window_stats(p):
    return p.build_scanstat()


@query("motion_blend", "SELECT * FROM moving", dbl="vy vx")
def motion_blend(p):
    return p.build_moving()


@query("advect_nowcast", "SELECT * FROM adv", dbl="rain")
def advect_nowcast(p):
    return p.build_adv().select("scan", "station_id", F.posexplode("adv").alias("lead", "rain")).withColumn("lead", F.col("lead") + 1)


@query("scan_trend", "SELECT scan, station_id, coalesce(d5,0) AS radar_trend11 FROM scanfeat", dbl="radar_trend11")
def scan_trend(p):
    return radar.scan_trend(p.scanstat, Slices(SLICES.chunk, order="scan"), "radar_r_mean5").select("scan", "station_id", "radar_trend11")


@query("asof_scan_to_minute", "SELECT * FROM near_scan")
def asof_scan_to_minute(p):
    return radar.asof_scan_to_minute(p.obs.select("station_id", "minute"), p.scanstat.select("station_id", "scan"), RADAR, SLICES)


LEAD = "greatest(least(coalesce(a.minute-a.scan,4)+1,5),1)"


@query("lead_pick", f"SELECT a.station_id, a.minute, a.minute-a.scan AS radar_age_min, adv[{LEAD}] AS nowcast_adv_t1, adv[least({LEAD}+4,5)] AS nowcast_adv_t5 "
       "FROM near_scan a LEFT JOIN scanfeat f ON f.station_id=a.station_id AND f.scan=a.scan", dbl="nowcast_adv_t1 nowcast_adv_t5")
def lead_pick(p):
    j = radar.asof_scan_to_minute(p.obs.select("station_id", "minute"), p.adv.select("station_id", "scan", "adv"), RADAR, SLICES)
    return radar.lead_pick(j, RADAR).select("station_id", "minute", "radar_age_min", "nowcast_adv_t1", "nowcast_adv_t5")


@query("radar_minute_channels", f"SELECT a.station_id, a.minute, {', '.join(STAT_DBL.split())}, radar_motion_v, radar_motion_u, CASE WHEN a.scan IS NOT NULL THEN coalesce(d5,0) END AS radar_trend11, "
       f"a.minute-a.scan AS radar_age_min, adv[{LEAD}] AS nowcast_adv_t1, adv[least({LEAD}+4,5)] AS nowcast_adv_t5 FROM near_scan a LEFT JOIN scanfeat f ON f.station_id=a.station_id AND f.scan=a.scan",
       dbl=STAT_DBL + " radar_motion_v radar_motion_u radar_trend11 nowcast_adv_t1 nowcast_adv_t5")
def radar_minute_channels(p):
    scans = p.scanfeat.drop("row", "col").withColumn("radar_r_mean11", F.col("radar_r_mean5"))
    return radar.radar_minute_channels(p.obs, scans, RADAR, SLICES).drop("radar_r_mean11")


@query("radar_gauge_check", """
SELECT s.station_id, CASE WHEN stddev_pop(r)>0 AND stddev_pop(g)>0 THEN corr(r,g) END AS corr, avg(r-g) FILTER (g>0 OR r>0.1) AS bias_mmh_wet,
 count(*) FILTER (r>0.1 AND g>0)/greatest(count(*) FILTER (g>0),1)::DOUBLE AS radar_pod, count(*) AS n_scans
FROM (SELECT s.station_id, radar_r_mean3 AS r, g FROM scanstat s JOIN (SELECT station_id, minute, CASE WHEN count(precip) OVER w>=8 THEN sum(precip) OVER w*6 END AS g
 FROM truth WINDOW w AS (PARTITION BY station_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) t ON t.station_id=s.station_id AND t.minute=s.scan
 WHERE radar_r_mean3 IS NOT NULL AND g IS NOT NULL) s GROUP BY 1 HAVING count(*)>=50 AND stddev_pop(g)>0""", dbl="corr bias_mmh_wet radar_pod")
def radar_gauge_check(p):
    return radar.radar_gauge_check(p.scanstat, p.targets, SLICES)


@query("station_coverage", "SELECT station_id, avg((radar_r_pix IS NOT NULL)::INT) AS coverage, avg((radar_r_pix IS NOT NULL)::INT)>=0.8 AS covered FROM scanstat GROUP BY 1", dbl="coverage")
def station_coverage(p):
    return radar.station_coverage(p.scanstat)


def _plane(lon: str, lat: str, lon0: str, lat0: str) -> tuple[str, str]:
    c = f"(sin(radians({lat0}))*sin(radians({lat}))+cos(radians({lat0}))*cos(radians({lat}))*cos(radians({lon}-({lon0}))))"
    x = f"(6378.137*cos(radians({lat}))*sin(radians({lon}-({lon0})))/{c})"
    y = f"(6378.137*(cos(radians({lat0}))*sin(radians({lat}))-sin(radians({lat0}))*cos(radians({lat}))*cos(radians({lon}-({lon0}))))/{c})"
    return x, y


X0, Y0 = _plane("ll_lon", "ll_lat", "lon0", "lat0")
PX, PY = _plane("lon", "lat", "lon0", "lat0")
GEO = ("SELECT DISTINCT vec_id%3 AS site, 9.9::DOUBLE+(vec_id%3)*0.3::DOUBLE AS ll_lon, 55.7::DOUBLE AS ll_lat, 10.5::DOUBLE+(vec_id%3)*0.3::DOUBLE AS lon0, "
       "56.1::DOUBLE AS lat0 FROM embeddings")
GRID_SQL = f"""
SELECT site, 0 AS geom_id, count(*) AS cells, min(2*6371.0*asin(least(1,sqrt(pow(sin(radians(lat0-lat)/2),2)+cos(radians(lat))*cos(radians(lat0))*pow(sin(radians(lon0-lon)/2),2))))) AS nearest_km,
 max(iy*160+ix) AS last_pixel FROM (SELECT *, CAST(floor(({PX}-{X0})/0.5) AS BIGINT) AS ix, 159-CAST(floor(({PY}-{Y0})/0.5) AS BIGINT) AS iy FROM (
  SELECT *, degrees(asin(cos(c)*sin(radians(56.1))+y*sin(c)*cos(radians(56.1))/rho)) AS lat,
   10.6+degrees(atan2(x*sin(c), rho*cos(radians(56.1))*cos(c)-y*sin(radians(56.1))*sin(c))) AS lon FROM (
   SELECT *, sqrt(x*x+y*y) AS rho, atan(sqrt(x*x+y*y)/6378.137) AS c FROM (
    SELECT g.*, c.i+0.5-40 AS x, 79-r.i+0.5-40 AS y FROM ({GEO}) g, (SELECT unnest(range(0,80)) AS i) r, (SELECT unnest(range(0,80)) AS i) c))))
WHERE ix>=0 AND ix<160 AND iy>=0 AND iy<160 GROUP BY 1"""


@query("site_grid_map", GRID_SQL, dbl="nearest_km", long="last_pixel")
def site_grid_map(p):
    return radar.site_grid_map(p.geometries, half_km=40.0).groupBy("site", "geom_id").agg(
        F.count(F.lit(1)).alias("cells"), F.min("dist_km").alias("nearest_km"), F.max("pixel").alias("last_pixel"))


@query("lookup_audit", f"""
SELECT site, quantile_cont(e,0.5) AS median_error_px, quantile_cont(e,0.5)*0.5 AS median_error_km, max(e)*0.5 AS max_error_km,
 count(*) FILTER (gx BETWEEN 0 AND 159 AND gy BETWEEN 0 AND 159) AS stations_inside_site_grid FROM (
 SELECT site, gx, gy, sqrt(pow(gx-ix,2)+pow(gy-iy,2)) AS e FROM (SELECT site, l.col AS ix, l.row AS iy, CAST(floor(({PX}-{X0})/0.5) AS BIGINT) AS gx, 159-CAST(floor(({PY}-{Y0})/0.5) AS BIGINT) AS gy
  FROM stations s JOIN ({GNOM}) l ON l.station_id=s.station_id, ({GEO}) WHERE l.row BETWEEN 2 AND 517 AND l.col BETWEEN 2 AND 517)) GROUP BY 1""",
       dbl="median_error_px median_error_km max_error_km")
def lookup_audit(p):
    px = radar.station_pixels(p.stations)
    lookup = p.stations.join(px.select("station_id", F.col("col").alias("ix"), F.col("row").alias("iy")), "station_id")
    return radar.lookup_audit(lookup, p.geometries)


def _motion_sql(least_now: str, least_before: str, peak: float, fields: str) -> str:
    """Exhaustive block matching: every tile, every shift up to the highest speed, cosine of the wet cells."""
    return f"""
SELECT {fields} FROM (SELECT q.*, up - 2*score + down AS by_, lft - 2*score + rgt AS bx_ FROM (
 SELECT *, max(score) FILTER (k=1) OVER w AS top_, any_value(u) FILTER (k=1) OVER w AS up, any_value(dn) FILTER (k=1) OVER w AS down, any_value(l) FILTER (k=1) OVER w AS lft, any_value(r) FILTER (k=1) OVER w AS rgt FROM (
  SELECT s.*, row_number() OVER (PARTITION BY scan,tr,tc ORDER BY score DESC, dy*dy+dx*dx, dy, dx) AS k,
   (SELECT max(x.score) FROM sc x WHERE x.scan=s.scan AND x.tr=s.tr AND x.tc=s.tc AND x.dy=s.dy-1 AND x.dx=s.dx) AS u, (SELECT max(x.score) FROM sc x WHERE x.scan=s.scan AND x.tr=s.tr AND x.tc=s.tc AND x.dy=s.dy+1 AND x.dx=s.dx) AS dn,
   (SELECT max(x.score) FROM sc x WHERE x.scan=s.scan AND x.tr=s.tr AND x.tc=s.tc AND x.dy=s.dy AND x.dx=s.dx-1) AS l, (SELECT max(x.score) FROM sc x WHERE x.scan=s.scan AND x.tr=s.tr AND x.tc=s.tc AND x.dy=s.dy AND x.dx=s.dx+1) AS r
  FROM sc s) WINDOW w AS (PARTITION BY scan,tr,tc)) q WHERE k=1) m
 JOIN now_ USING (scan,tr,tc) LEFT JOIN old_ USING (scan,tr,tc) WHERE wet_now {least_now} AND {least_before} AND score >= {peak}"""


TILED = "(SELECT unnest(range(0,{n}+1,{s})) AS tr) a, (SELECT unnest(range(0,{n}+1,{s})) AS tc) b WHERE row>=tr AND row<tr+{t} AND col>=tc AND col<tc+{t}"


def _motion_cte(tile: int, step: int) -> str:
    cut = TILED.format(n=8 - tile, s=step, t=tile)
    return f"""wet AS (SELECT scan, row, col, ln(1+rain) AS a FROM comp WHERE rain>0),
pr AS (SELECT * FROM (SELECT scan, lag(scan) OVER (ORDER BY scan) AS prev FROM (SELECT DISTINCT scan FROM comp)) WHERE scan-prev<=30),
cur AS (SELECT w.* FROM wet w JOIN pr USING (scan)), bef AS (SELECT pr.scan, pr.scan-prev AS dt, row, col, a FROM wet w JOIN pr ON pr.prev=w.scan),
now_ AS (SELECT scan, tr, tc, count(*) AS wet_now, sum(a*a) AS bb FROM cur, {cut} GROUP BY 1,2,3), old_ AS (SELECT scan, tr, tc, count(*) AS wet_before FROM bef, {cut} GROUP BY 1,2,3),
mov AS (SELECT scan, dt, row+dy AS row, col+dx AS col, dy, dx, a FROM bef, (SELECT unnest(range(-7,8)) AS dy) y, (SELECT unnest(range(-7,8)) AS dx) x WHERE dy*dy+dx*dx<=pow(2.5*dt,2)),
hit AS (SELECT m.*, c.a AS b FROM mov m LEFT JOIN cur c ON c.scan=m.scan AND c.row=m.row AND c.col=m.col),
sc AS MATERIALIZED (SELECT h.scan, dt, h.tr, h.tc, dy, dx, round(coalesce(ab,0)/sqrt(aa*bb), 9) AS score FROM (SELECT scan, dt, tr, tc, dy, dx, sum(a*b) AS ab, sum(a*a) AS aa FROM hit, {cut} GROUP BY ALL) h JOIN now_ n ON n.scan=h.scan AND n.tr=h.tr AND n.tc=h.tc)"""


SHIFT = "(dy+coalesce(CASE WHEN by_<0 THEN 0.5*(up-down)/by_ END,0))/dt AS vy, (dx+coalesce(CASE WHEN bx_<0 THEN 0.5*(lft-rgt)/bx_ END,0))/dt AS vx"
TILES_SQL = f"WITH {_motion_cte(4, 2)} {_motion_sql('>= 0.32', 'wet_before >= 0.32', 0.05, f'scan, tr+2.0 AS tile_r, tc+2.0 AS tile_c, {SHIFT}')}"
WHOLE_SQL = f"WITH {_motion_cte(8, 8)} {_motion_sql('> 0.32', 'true', -9, f'scan, {SHIFT}')}"


@query("tile_motion", f"SELECT * FROM ({TILES_SQL})", dbl="tile_r tile_c vy vx", digits=4)
def tile_motion(p):
    return radar.tile_motion(p.comp, RADAR)[0]


@query("whole_field_motion", f"SELECT * FROM ({WHOLE_SQL})", dbl="vy vx", digits=4)
def whole_field_motion(p):
    return radar.tile_motion(p.comp, RADAR, coarse=3)[1]
