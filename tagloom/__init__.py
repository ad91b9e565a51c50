"""Spark operators for preparing and analysing large corpora of tagged posts."""
