"""Spark-native analytics for evaluating models over large labelled tables."""
