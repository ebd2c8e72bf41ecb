"""tally: ledger analytics as Spark jobs.

Every operator is a DataFrame -> DataFrame function built from Catalyst
expressions; see README.md for the operator map.
"""

__version__ = "0.1.0"
