"""Training-data operators: deduplication, filters, tokenisation and scans over whole corpora.

Nothing outside this package imports it. ``registry`` holds the queries of the operators and
their SQL.
"""
