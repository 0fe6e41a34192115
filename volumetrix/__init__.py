"""File-system metadata analytics on Spark: trees of files, path search, change journals."""
