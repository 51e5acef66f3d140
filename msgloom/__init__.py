"""Spark jobs that turn messages into schedule events and into training and evaluation data."""
