"""Data quality on Spark: profile, clean, compare, audit."""
