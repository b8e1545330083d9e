"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, licenses, linededup, pii, quality, repair, secrets, simhash, suffix, variants, winnow

_MODULES = (pii, quality, bpe, simhash, decontaminate, licenses, linededup, chat, secrets, winnow, variants, suffix, repair)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
