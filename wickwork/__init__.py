"""Candle time series on Spark: ingestion, keyed tables, gap filling and supervised framing."""
