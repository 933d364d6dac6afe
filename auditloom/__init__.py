"""Spark-native analytics for auditing deployed segmentation models."""
