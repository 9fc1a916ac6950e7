"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language, mixing, neardup, pii, quality, substring, tokens, urls, warc

MODULES = [decontaminate, language, mixing, neardup, pii, quality, substring, tokens, urls, warc]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
