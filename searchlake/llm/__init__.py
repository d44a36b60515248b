"""Operators for training data; nothing else in the library imports this subpackage."""

from importlib import import_module

MODULES = ["url_copies", "rank_fusion", "distinctive_terms", "term_counts", "bpe_corpus", "leaked_passages", "garbled_text", "markup_templates", "page_body"]


def query_modules() -> list:
    """The modules with QUERIES and SQL."""
    return [import_module(f"{__name__}.{m}") for m in MODULES]
