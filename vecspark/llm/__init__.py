"""Training-data operators: ten corpus operators and the pipeline stages built from them.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
