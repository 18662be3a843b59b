"""Gridloom: field, volume, graph and plot-table analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
