"""Arrival-prediction accuracy on Spark: DataFrame and stream operators for transit data."""
