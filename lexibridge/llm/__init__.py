"""Training-data operators. Nothing outside this package imports it.

Each module holds one operator with its own general interface; `queries.py`
derives from them the digest columns of the registered `opN_<name>` queries.
"""
