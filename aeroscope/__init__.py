"""Spark jobs for flight-instruction safety, transcript scoring and extracted-knowledge quality."""
