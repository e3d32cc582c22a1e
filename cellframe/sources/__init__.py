"""Scans of image, cell and annotation tables, and the sinks that write results."""
