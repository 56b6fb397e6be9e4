"""Incremental runs: work arrives as pending egos and results are appended."""
