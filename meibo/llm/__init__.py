"""Operators on texts and matches for language-model corpora; nothing else in the library imports this."""

from meibo.llm import queries

QUERY_MODULES = [queries]
