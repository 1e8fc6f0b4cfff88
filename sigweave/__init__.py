"""Signals and tables to symbolic token sequences, as Spark DataFrame operators."""
