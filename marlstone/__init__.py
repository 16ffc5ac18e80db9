"""Marlstone: a PySpark-native analytics engine for data-consortium workloads.

Every operator is a function from DataFrames to a DataFrame; Catalyst and AQE
pick the physical plan.
"""
