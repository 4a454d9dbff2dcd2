"""Corpus-to-training-set and evaluation bookkeeping jobs on PySpark."""
