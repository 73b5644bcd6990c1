"""Operators for preparing large training-data corpora.

Nothing outside this folder imports it.  Every operator takes a DataFrame, the
names of the columns it uses, and returns a DataFrame with fixed column names;
other columns of the input are never read, so clashing names do no harm.
"""
