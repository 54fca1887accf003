"""Columnar dataflow on Spark."""
