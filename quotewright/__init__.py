"""Spark-native replay and analytics of limit-order-book event data."""
