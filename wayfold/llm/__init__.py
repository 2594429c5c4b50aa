"""Operators for training-data pipelines. Nothing else in wayfold imports this subpackage."""
