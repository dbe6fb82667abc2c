"""Operators of a training-data pipeline over the tables ``documents``,
``pages`` and ``labels``.

One module per operator; ``registry`` names the queries.  Nothing else in the
library imports this subpackage.
"""
