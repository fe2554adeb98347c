"""Compositions of operators into whole runs (pipeline, full analysis, report)."""
