"""Site atlas: captured web sites as Spark tables.

The library is a set of functions over DataFrames and Columns.  ``functions``
holds Column expressions, ``sources`` readers and writers, ``operators``
DataFrame-to-DataFrame steps, ``plans`` whole jobs built from them, and
``streaming`` the Structured Streaming forms.
"""
