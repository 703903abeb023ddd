"""Column-level building blocks: money, keys, dates, buckets, numeric helpers."""
