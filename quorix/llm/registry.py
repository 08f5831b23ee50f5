"""The queries of this package, one for each operator."""

from __future__ import annotations

from importlib import import_module

#: One module for each operator, by number.
MODULES = ("simhash", "toxicity", "decontaminate", "bpe", "linededup", "quality", "ppm", "html", "warc", "suffix")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = import_module(f"quorix.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= getattr(_module, "ORACLE", {})
