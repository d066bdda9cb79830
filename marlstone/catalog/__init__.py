"""Queries by family; importing the package registers them."""

from marlstone.catalog import checks, code, documents, graphs, indexes, operations, retrieval, roundtrips, scalars, texts, writes  # noqa: F401
