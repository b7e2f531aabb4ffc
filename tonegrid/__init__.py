"""Spark-native feature tables over corpora of audio, events, words and embeddings.

Missing values are SQL NULL inside the engine; NaN exists only at NumPy borders.
"""

__version__ = "0.1.0"
