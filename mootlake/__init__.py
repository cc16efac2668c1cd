"""mootlake: Spark-native analytics over recorded meetings."""
