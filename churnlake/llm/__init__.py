"""Training-data operators: filtering, scoring, de-duplication, encoding and formatting of text corpora.

Nothing else in the library imports this subpackage. Every operator works on a
DataFrame with caller-named id and text columns, reads whole texts, and keeps its
intermediates inside Spark or in the shared folder of ``spark.checkpoint.dir``.
"""
