"""Operators for training-data pipelines: filters, classifiers, deduplication, decontamination and packing."""
