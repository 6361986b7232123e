"""strataflow: aggregated incidence results on Spark DataFrames.

Layers, lowest first:

* ``functions``  column expressions (missing-value rules, text, dates, numbers)
* ``operators``  one DataFrame step each (projection, filter, join, aggregate, window, set, reshape)
* ``sources``    files, schemas, fixed dimensions
* ``plans``      composed analyses (display tables, overlay, segmented regression, correlation)
* ``catalog``    the queries registered for checking, and their SQL twins
"""
