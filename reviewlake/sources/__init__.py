"""Scans, field extraction and sinks."""
