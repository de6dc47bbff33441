"""Operators for training-data pipelines. Nothing outside this subpackage imports it, except the entry file and the pipeline."""
