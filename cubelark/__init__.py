"""A Spark-native engine for star-schema analytics: relational operators, a query set and an OLAP cube."""
