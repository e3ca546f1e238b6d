"""Herd sensor analytics on Spark: readings and life-cycle documents in, features, labels and models out."""
