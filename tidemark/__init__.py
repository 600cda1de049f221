"""Point-in-time, cross-sectional analytics expressed as Spark DataFrame pipelines."""
