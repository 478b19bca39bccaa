"""A Spark-native engine for analysing collections of source files and text."""
