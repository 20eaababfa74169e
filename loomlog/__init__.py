"""loomlog: log analytics on Spark DataFrames.

Text logs become typed rows, restricted SQL runs over them as Catalyst plans, and results go to
CSV, SQL text or JDBC.  Subpackages: ``functions`` (formats, grok, encodings of rules), ``sources``,
``plans`` (SQL front end), ``operators``, ``sinks`` and ``streaming``.
"""
