"""textquarry: a Spark-native engine for corpus analytics."""
