"""Spark jobs for network-operations procedures: documents, run logs and fleets as DataFrames."""
