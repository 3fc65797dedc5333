"""Loomstone: a PySpark-native analytics engine for agent activity logs."""
