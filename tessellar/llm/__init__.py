"""Training-data operators.

Nothing outside this subpackage imports it.  Every operator takes a
DataFrame and returns a DataFrame; nothing is collected but bounded
samples, scalars and fitted models of a documented size.
"""
