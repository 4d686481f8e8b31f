"""Finding the JSON in what a model wrote."""

from __future__ import annotations

import json

_DECODER = json.JSONDecoder()


def recover_json(text: str | None):
    """The first JSON object or array in ``text``, whatever stands around it
    (fences, a preamble, notes). None where there is none or it is cut off.

    An opening bracket that fails at once (a brace in the preamble) is passed
    over; a value that breaks off later on is a cut-off response.
    """
    if not text:
        return None
    at = 0
    while True:
        starts = [p for p in (text.find("{", at), text.find("[", at)) if p >= 0]
        if not starts:
            return None
        begin = min(starts)
        try:
            value, _ = _DECODER.raw_decode(text, begin)
        except RecursionError:
            return None
        except ValueError as error:
            if getattr(error, "pos", len(text)) - begin > 2:
                return None
            at = begin + 1
            continue
        if isinstance(value, (dict, list)) and value:
            return value
        at = begin + 1


def embedded_json(value):
    """A list or object written as a JSON string; anything else as it is."""
    if isinstance(value, str):
        trimmed = value.strip()
        if len(trimmed) > 1 and (trimmed[0], trimmed[-1]) in (("[", "]"), ("{", "}")):
            try:
                inner = json.loads(trimmed)
            except (ValueError, RecursionError):
                return value
            if isinstance(inner, (list, dict)):
                return inner
    return value
