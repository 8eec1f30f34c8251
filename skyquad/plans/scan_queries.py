"""Queries that write a table in one of the file formats, to the shared folder, and read it back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skyquad.operators import synthetic
from skyquad.plans.catalog_queries import r
from skyquad.plans.quad_queries import PATTERNS_SQL
from skyquad.plans.tables import PATCH_SQL, STARS_SQL, VECTOR_SQL, load, patch, stars
from skyquad.sources import binary, catalog_csv, encoded
from skyquad.sources.store import shared_dir, written


def astr_scan(spark, sf_dir):
    path = f"{shared_dir(spark, 'catalog')}.astr"
    binary.write_astr(stars(spark, sf_dir), path)
    return binary.read_astr(spark, path).select("position", "id", *[r(F.col(c), 5).alias(c) for c in ("ra_deg", "dec_deg", "mag")], *[r(F.col(c), 6).alias(c) for c in "xyz"])


def _database(spark, sf_dir) -> str:
    path = f"{shared_dir(spark, 'database')}.adb"
    s = written(synthetic.solver_stars(patch(spark, sf_dir)), "solver_stars")
    binary.write_adb(s, synthetic.nearest_patterns(s), path, 10.0, 30.0)
    return path


def adb_header(spark, sf_dir):
    return binary.read_adb(spark, _database(spark, sf_dir), "header").select("version", "n_stars", "n_patterns", *[F.col(c).cast("double").alias(c) for c in ("min_fov_deg", "max_fov_deg", "max_mag")], "epoch", "pattern_size", "pattern_bins")


def adb_stars(spark, sf_dir):
    """An unknown magnitude is a NaN in the file."""
    s = binary.read_adb(spark, _database(spark, sf_dir))
    return s.select("star_index", "catalog_id", *[F.when(~F.isnan(c), r(F.col(c).cast("double"), 5)).alias(c) for c in ("ra_rad", "dec_rad", "x_unit", "y_unit", "z_unit", "mag")])


def adb_patterns(spark, sf_dir):
    return binary.read_adb(spark, _database(spark, sf_dir), "patterns")


def adb_star_lookup(spark, sf_dir):
    """One star by its number: only its record is read."""
    return binary.read_adb(spark, _database(spark, sf_dir)).filter("star_index = 9").select("star_index", "catalog_id")


def adb_pattern_lookup(spark, sf_dir):
    return binary.read_adb(spark, _database(spark, sf_dir), "patterns").filter("pattern_index = 7")


def csv_scan(spark, sf_dir):
    path = shared_dir(spark, "plain_csv")
    catalog_csv.write_plain(stars(spark, sf_dir), path)
    return catalog_csv.read_plain(spark, path).select("id", r(F.col("ra_deg"), 8).alias("ra_deg"), r(F.col("dec_deg"), 8).alias("dec_deg"), "mag")


def hipparcos_scan(spark, sf_dir):
    """A file with rows that the reader has to refuse, and bad magnitudes."""
    path, k = shared_dir(spark, "hipparcos_csv"), F.col("c_custkey")
    text = lambda c, bad, n: F.when(k % n == 0, F.lit(bad)).otherwise(c.cast("string"))
    rows = load(spark, sf_dir, "customer").select(text(k, "x", 11).alias("HIP"), text(k % 90 / 8, "?", 7).alias("Vmag"), text(k % 360 / 4, "", 13).alias("RA_ICRS_deg"), (k % 200 - 100).cast("string").alias("DE_ICRS_deg"))
    rows.write.csv(path, header=True)
    return catalog_csv.read_hipparcos(spark, path)


def _packed(stars: pd.DataFrame) -> pd.DataFrame:
    """The bytes of a database of some customers; every third one is cut short by a byte."""
    stars = stars.sort_values("c_custkey")
    rows = np.zeros(len(stars), dtype=binary.ADB_STAR)
    rows["catalog_id"], rows["mag"] = stars["c_custkey"], stars["c_custkey"] % 64 / 8
    data = binary.ADB_HEAD.pack(binary.ADB_MAGIC, binary.VERSION, len(rows), 0, 1.0, 60.0, 7.0, 2000, 4, 50) + rows.tobytes()
    k = int(stars["db_id"].iloc[0])
    return pd.DataFrame({"db_id": [k], "content": [data[: len(data) - (k % 3 == 2)]]})


def databases_as_bytes(spark, sf_dir):
    """The stars of databases that stand as bytes in a column, one for each 50 customers."""
    rows = load(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).alias("db_id"), "c_custkey")
    packed = rows.groupBy("db_id").applyInPandas(_packed, "db_id long, content binary")
    return encoded.decoded(packed).select("db_id", "error", "star_index", "catalog_id", F.col("mag").cast("double").alias("mag"))


_PS = f"""{PATCH_SQL}, ps as (select row_number() over (order by coalesce(mag, 99), id) - 1 as star_index, id as catalog_id, ra_deg, dec_deg, mag, {VECTOR_SQL} from patch)"""
SQL = {
    "databases_as_bytes": """with d as (select c_custkey // 50 as db_id, c_custkey, row_number() over (partition by c_custkey // 50 order by c_custkey) - 1 as i, count(*) over (partition by c_custkey // 50) as n from customer)
select db_id, null as error, i::int as star_index, c_custkey as catalog_id, c_custkey % 64 / 8.0::double as mag from d where db_id % 3 <> 2
union all select distinct db_id, 'Truncated: stars: ' || (n - 1) || ' of ' || n || ' records are there', null, null, null from d where db_id % 3 = 2""",
    "astr_scan": f"with {STARS_SQL}, v as (select *, {VECTOR_SQL} from stars) select row_number() over (order by id) - 1 as position, id, {', '.join(f'round({c}::float::double, {d}) + 0 as {c}' for c, d in (('ra_deg', 5), ('dec_deg', 5), ('mag', 5), ('x', 6), ('y', 6), ('z', 6)))} from v",
    "adb_header": f"with {PATTERNS_SQL} select 1::bigint as version, (select count(*) from ps) as n_stars, (select count(*) from pv) as n_patterns, 10.0::double as min_fov_deg, 30.0::double as max_fov_deg, 7.0::double as max_mag, 2000::bigint as epoch, 4::bigint as pattern_size, 50::bigint as pattern_bins",
    "adb_stars": f"with {_PS} select star_index::int as star_index, catalog_id, {', '.join(f'round(({c})::float::double, 5) + 0 as {n}' for n, c in (('ra_rad', 'radians(ra_deg)'), ('dec_rad', 'radians(dec_deg)'), ('x_unit', 'x'), ('y_unit', 'y'), ('z_unit', 'z'), ('mag', 'mag')))} from ps",
    "adb_patterns": f"with {PATTERNS_SQL} select row_number() over (order by s) - 1 as pattern_index, {', '.join(f's[{k + 1}]::int as s{k}' for k in range(4))} from pt",
    "adb_star_lookup": f"with {_PS} select star_index::int as star_index, catalog_id from ps where star_index = 9",
    "adb_pattern_lookup": f"with {PATTERNS_SQL} select * from (select row_number() over (order by s) - 1 as pattern_index, {', '.join(f's[{k + 1}]::int as s{k}' for k in range(4))} from pt) where pattern_index = 7",
    "csv_scan": f"with {STARS_SQL} select id, round(ra_deg, 8) + 0 as ra_deg, round(dec_deg, 8) + 0 as dec_deg, mag from stars",
    "hipparcos_scan": "select c_custkey as id, c_custkey % 360 / 4.0::double as ra_deg, (c_custkey % 200 - 100)::double as dec_deg, case when c_custkey % 7 <> 0 then c_custkey % 90 / 8.0::double end as mag from customer where c_custkey % 11 <> 0 and c_custkey % 13 <> 0 and c_custkey % 200 between 10 and 190",
}
QUERIES = {f.__name__: f for f in (databases_as_bytes, astr_scan, adb_header, adb_stars, adb_patterns, adb_star_lookup, adb_pattern_lookup, csv_scan, hipparcos_scan)}
