"""Trajectory and time-series analytics on PySpark DataFrames."""
