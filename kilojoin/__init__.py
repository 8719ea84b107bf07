"""Sampled signals and source-to-sink flow networks as PySpark DataFrames."""
