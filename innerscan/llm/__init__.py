"""Training-data operators: dedup, packing, mixing, search, scoring and fingerprints.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries.py`` registers the thin
``opN_<name>`` queries and ``oracle.py`` the SQL they are checked against.
"""
