"""Scans of landed records and files, sinks, and the incremental table layout."""
