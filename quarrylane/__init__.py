"""Spark jobs for image-mask datasets and their scores."""
