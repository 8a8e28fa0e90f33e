"""Document analytics on Spark: files, outlines, tables, page layout."""
