"""Marlstone: a Spark-native analytics engine for text, graphs, events and corpora."""

__version__ = "0.1.0"
