"""geotrail: a PySpark-native analytics engine for location histories.

Sub-packages: ``functions`` (column builders), ``operators`` (DataFrame operators), ``sources``
(readers, stores, sinks), ``plans`` (composed queries), ``streaming``, and the optional ``llm``.
"""

__version__ = "0.1.0"
