"""Words: runs of letters and digits, without regard to case."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.casefold()) if text else []
