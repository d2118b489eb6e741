"""A Spark-native engine for clinical-trial analytics."""
