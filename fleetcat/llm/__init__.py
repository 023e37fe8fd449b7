"""Training-data operators for very large corpora.

One module per operator (``op1`` ... ``op13``), ``words`` with the vectorised
text primitives they share, ``queries`` with the registered queries.  Nothing
outside this subpackage imports it.
"""
