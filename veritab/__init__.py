"""Evaluation-evidence engine: labelled-corpus preparation and classifier audits on Spark."""
