"""Spark-first analytics over a multi-tenant knowledge store.

* ``functions``  column expressions (identifiers, text, vectors, tags)
* ``sources``    table and file readers
* ``operators``  DataFrame-to-DataFrame operators
* ``plans``      registered queries with their SQL oracles
* ``streaming``  Structured Streaming forms of the time-driven operators
* ``llm``        optional: operators for training-data pipelines; nothing else imports it
"""
