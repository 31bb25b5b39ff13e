"""Spark-native analytics over ledgers of transactional documents."""
