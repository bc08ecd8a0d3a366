"""Spark-native evidence reconciliation and estate analytics over DataFrames."""
