"""Site-content analytics on Spark: pages in, typed tables, audits and rollups out."""
