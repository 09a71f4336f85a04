"""Spark-native analytics over speech recordings that were already probed, diarized and transcribed."""
