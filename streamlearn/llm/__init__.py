"""Operators for preparing language-model training data.

One module per operator; ``registry`` collects their queries and SQL.  Nothing
outside this package (and ``corpus_pipeline.py``) imports it.
"""
