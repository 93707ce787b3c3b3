"""Detection-table analytics on Spark: boxes in, measured and matched objects out."""
