"""Spark-native analytics over captured HTTP and gRPC traffic."""
