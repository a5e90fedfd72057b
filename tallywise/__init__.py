"""Business-table analytics on Spark DataFrames.

Layout
------
``sources``    readers, writers, guarded SQL
``functions``  column expressions and fixed vocabularies
``operators``  DataFrame -> DataFrame analytics
``plans``      multi-operator jobs (overview, answers, findings)
``catalog``    the registered queries with their DuckDB counterparts
"""
