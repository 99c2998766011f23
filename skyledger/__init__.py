"""Drone-survey and reconstruction-quality analytics as Spark jobs."""
