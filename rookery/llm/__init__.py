"""Training-data operators over text, conversation and embedding tables.

Nothing outside this folder, `corpus_pipeline.py` and the entry module imports it.
"""
