"""Training-data operators: each module holds one operator with its own general interface.

``queries`` holds the thin contract queries.  Nothing outside this folder imports it.
"""
