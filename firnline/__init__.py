"""Spark jobs and queries for alpine snow, weather and accident records."""
