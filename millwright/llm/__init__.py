"""Operators for preparing training corpora: tokenizing, packing, extraction, deduplication, screening.

Every operator is a function from DataFrame to DataFrame.  ``queries`` holds the thin ``opN_*`` queries that apply
each operator with production parameters to its whole table, ``oracle`` their SQL where SQL can say the same.
"""
