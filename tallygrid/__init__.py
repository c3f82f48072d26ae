"""Fundamentals analytics on Spark: DataFrame operators for entity x period x metric facts."""
