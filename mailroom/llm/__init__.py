"""Training-data operators: one module for each, and ``queries`` for the
registered queries. Nothing outside this subpackage imports it."""
