"""Queries over the driver's tables: each applies the library's operators to a surrogate relation, named in its docstring."""
