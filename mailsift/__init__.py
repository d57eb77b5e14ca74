"""Mail-triage analytics on PySpark DataFrames.

``functions``  Column builders (text cleaning, headers, verdicts, risk rules)
``operators``  DataFrame -> DataFrame operators (filters, joins, windows, roll-ups)
``sources``    readers and sinks
``streaming``  Structured Streaming jobs
``plans``      registered queries with their SQL equivalents
"""

__version__ = "0.1.0"
