"""Training-data operators: ten corpus operators, each its own module.

Nothing outside this subpackage imports it; ``queries.py`` binds the operators
to the tables of a data directory.
"""
