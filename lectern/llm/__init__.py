"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus the names of the columns it reads, selects only those columns
(so further columns, whatever their names, cannot clash with its own), and
returns a DataFrame.
"""
