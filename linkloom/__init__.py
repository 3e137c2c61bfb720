"""Crawl-frontier analytics on Spark: links in, next batch out, all as DataFrames."""
