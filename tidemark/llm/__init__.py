"""Training-data operators: ten corpus operators, each in a module of its own.

Nothing outside this subpackage imports it.  Modules hold the operators with
their general interfaces; ``queries`` holds the thin digest queries.
"""
