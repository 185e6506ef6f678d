"""Operators for training-data pipelines. Nothing else in datagauge imports this subpackage."""
