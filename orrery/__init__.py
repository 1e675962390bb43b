"""Spark-native discovery analytics: DataFrame operators over works, references and concepts."""
