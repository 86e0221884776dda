"""A Spark-native labour-market analytics engine: operators are functions from DataFrame to DataFrame."""
