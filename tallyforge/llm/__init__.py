"""Training-data operators: each module is one operator with its own general interface.

Nothing else in the library imports this subpackage; queries.py binds the operators to tables.
"""
