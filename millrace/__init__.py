"""A Spark-native engine for building, cleaning, measuring and preparing large text corpora."""
