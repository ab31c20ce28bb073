"""Operators for large training corpora; nothing outside this folder (and corpus_pipeline.py) imports it."""
