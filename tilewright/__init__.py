"""Spark-native analytics over small grids, ordered events, signals and labelled corpora."""
