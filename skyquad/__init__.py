"""Star-field matching on Spark: catalogs, geometry, quad hashing, candidate search, verification and source detection as DataFrame operators."""
