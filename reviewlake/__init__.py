"""Spark-native review and short-text analytics.

Sub-packages: ``functions`` (column expressions), ``operators``
(DataFrame -> DataFrame), ``sources`` (scans and sinks), ``plans`` (whole
jobs) and ``streaming`` (incremental runs of the same operators).
"""
