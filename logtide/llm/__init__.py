"""Operators for preparing language-model training data on Spark.

Each module holds one operator with a general interface; ``queries`` derives the
registered ``opN_*`` tables from them.  Nothing outside this subpackage imports it.
"""
