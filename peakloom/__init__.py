"""A Spark-native engine that matches a library of expected signals against measured ones."""
