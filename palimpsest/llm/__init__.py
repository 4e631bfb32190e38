"""Training-data operators: one module for each, plus ``queries`` with the registered ones.

Nothing else in the library imports this subpackage.
"""
