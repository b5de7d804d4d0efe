"""Spark-native data engine for collections of tables and tabular learning."""
