"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames, works on whole tables and whole texts,
and keeps what it gathers on the driver to a size fixed by its parameters. The
queries over the test tables are in ``queries.py``; the chain of stages is in
``corpus_pipeline.py`` at the top of the repository.
"""
