"""Spark-native screening of payment and procurement ledgers, and corpus preparation."""
