"""Spark-native analytics for multichannel signals, events and intervals."""
