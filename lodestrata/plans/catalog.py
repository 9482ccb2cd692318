"""All queries of the library and their SQL."""

from __future__ import annotations

from . import catalog_examples, catalog_links, catalog_more, catalog_rules, catalog_tables, catalog_text
from .catalog_text import flagship

__all__ = ["QUERIES", "SQL", "flagship"]

QUERIES = {**catalog_text.QUERIES, **catalog_tables.QUERIES, **catalog_more.QUERIES, **catalog_rules.QUERIES, **catalog_links.QUERIES, **catalog_examples.QUERIES}
SQL = {**catalog_text.SQL, **catalog_tables.SQL, **catalog_more.SQL, **catalog_rules.SQL, **catalog_links.SQL, **catalog_examples.SQL}
