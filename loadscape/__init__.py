"""Spark-native engine for pools of load-profile series and their feature space."""
