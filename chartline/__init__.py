"""chartline: timeline analytics for entity-event tables on PySpark.

Everything is a function from DataFrame to DataFrame over a small set of
canonical column names (see README), so operators chain with
``df.transform(...)`` and Catalyst sees one declarative plan.
"""
