"""Training-data operators: filters, deduplication, mixing, extraction, scoring, tokens.

Every module holds one operator with a general interface.  ``queries.py`` binds
them to the driver's tables; nothing outside this package imports it.
"""
