"""Transcript and moment analytics as Spark DataFrame operators."""
