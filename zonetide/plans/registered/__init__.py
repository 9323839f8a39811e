"""Queries over the provided tables, each with the SQL it has to agree with.

The provided tables hold no domain data, so every query maps a role of the library onto
them: pages are home pages, words of documents are dictionary words, orders are uploads.
"""

from . import cursors, dimensions, documents, entries, merges, names, reports, shares, streams, tables, words  # noqa: F401
from .registry import REGISTRY  # noqa: F401
