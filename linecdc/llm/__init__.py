"""Operators of a training-data pipeline, each a Spark job over a DataFrame.

Nothing outside this folder imports it. ``queries.py`` registers one query per
operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
