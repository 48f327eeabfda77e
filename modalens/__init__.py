"""Spark-native audits of studies made of several sample-by-feature tables."""
