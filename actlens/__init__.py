"""Spark-native datasets that pair model activations with text explaining them."""

__version__ = "0.1.0"
