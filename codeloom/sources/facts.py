"""Rows of facts that every extractor gives."""

from __future__ import annotations

FACTS = (
    "path string, kind string, name string, parent string, line bigint, target string, cc bigint, nesting bigint, "
    "last bigint, exported boolean, is_test boolean"
)


def row(path, kind, name, parent="", line=None, target=None, cc=None, nesting=None, last=None, exported=None, is_test=None) -> tuple:
    return path, kind, name, parent, line, target, cc, nesting, last, exported, is_test
