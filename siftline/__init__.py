"""siftline: a Spark-native engine for scanning text with rules and for post-processing findings."""
