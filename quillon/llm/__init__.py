"""Training-data operators: ten self-contained modules and the queries over them.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
