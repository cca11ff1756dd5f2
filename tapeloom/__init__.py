"""Spark-native equity research analytics: factors, rules, backtests, reviews."""
