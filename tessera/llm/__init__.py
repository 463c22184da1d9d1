"""Text and vector operators for preparing training corpora, written as Spark jobs.

The rest of the library never imports this package; it can be removed as a whole.
"""
