"""Every query of the engine, by name, with the SQL to hold it against."""

from __future__ import annotations

from skyquad.plans import catalog_queries, image_queries, quad_queries, scan_queries, solve_queries

QUERIES: dict = catalog_queries.QUERIES | quad_queries.QUERIES | image_queries.QUERIES | solve_queries.QUERIES | scan_queries.QUERIES
SQL: dict[str, str] = catalog_queries.SQL | quad_queries.SQL | image_queries.SQL | solve_queries.SQL | scan_queries.SQL


def flagship(spark, sf_dir):
    """Frames made from a patch of stars are solved against the patterns of that patch."""
    return QUERIES["plate_solve"](spark, sf_dir)
