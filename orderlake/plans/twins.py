"""Composes SQL twins from named common table expressions."""

from __future__ import annotations

import re

from orderlake.sources import adapters

CTE: dict[str, str] = dict(adapters.SQL)


def sql(body: str, **extra: str) -> str:
    """The body with the expressions that it needs, in order."""
    known = CTE | extra
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z]_\w+\b", text):
            if name in known and name not in needed:
                need(known[name])
                needed.append(name)

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed) + "\n" if needed else "") + body
