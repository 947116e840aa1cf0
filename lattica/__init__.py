"""Lattica: a knowledge-graph analytics engine written for Spark."""

__version__ = "0.1.0"
