"""colscan: columnar scans and chunk-level analytics on PySpark."""
