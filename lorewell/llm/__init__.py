"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; each
module's docstring states its method, its parameters and its result on null, empty, tied and
repeated rows.
"""
