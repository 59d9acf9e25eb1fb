"""Composed plans and the catalog of registered queries."""

from . import catalog, catalog_more, catalog_new, catalog_older  # noqa: F401
