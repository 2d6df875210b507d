"""ledgerloom: a PySpark-native analytics engine for tabular public-works ledgers.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (scalar columns), ``operators`` (relational and
data-quality operators), ``plans`` (named queries with their SQL), ``streaming`` (Structured Streaming) and the
optional ``llm`` (training-data operators, which nothing outside it imports).
"""

__version__ = "0.1.0"
