"""Nearest-neighbour forecasting on Spark: features, kNN joins over space-filling curves, prediction, metrics and scale search."""
