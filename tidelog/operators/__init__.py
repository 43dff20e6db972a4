"""Operators over logs, offsets, groups, transactions and replicas: functions from DataFrames to DataFrames."""
