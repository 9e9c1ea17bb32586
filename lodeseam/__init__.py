"""Exact subgroup discovery and exceptional-model mining on Spark DataFrames."""
