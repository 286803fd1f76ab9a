"""Spark-native log analytics: sources, parsing, stitching, timelines, paging and live tailing."""
