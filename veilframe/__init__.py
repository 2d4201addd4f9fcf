"""Masking, privacy metrics and masked analytics as Spark DataFrame programs."""
