"""A Spark-native toolkit for very wide tables: scan, filter, statistics, layout, import and export."""
