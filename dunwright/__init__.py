"""Failed-payment recovery analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  Packages:

* ``functions``  column expressions (scorecard, bands, policy, validation, text)
* ``operators``  table-level operators built from those expressions
* ``sources``    readers, writers and the event-log adapter
* ``streaming``  the same operators wired to Structured Streaming
* ``plans``      the registered queries and their SQL oracles
"""
