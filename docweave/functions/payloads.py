"""Model payloads: JSON text to typed entity and relation items, all or nothing."""

from __future__ import annotations

import json
import re

# Evidence limit and default confidence.
EVIDENCE_MAX = 500
DEFAULT_CONFIDENCE = 0.5
_WHOLE = re.compile(r"\s*[+-]?\d+(\.0+)?\s*")


class PayloadError(ValueError):
    """A payload that is turned down; the message is its reason."""


def _text(value: object) -> str:
    if not isinstance(value, str):
        raise PayloadError("not a text")
    return value


def _first(item: dict, *names: str) -> object:
    """The first member that is there and not null."""
    return next((item[n] for n in names if item.get(n) is not None), None)


def _whole(value: object) -> int:
    """A whole number of 32 bits, also as a text or without fraction; not negative."""
    if isinstance(value, str) and _WHOLE.fullmatch(value):
        value = int(float(value)) if "." in value else int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if not isinstance(value, int) or not 0 <= value < 1 << 31:
        raise PayloadError("not an offset")
    return int(value)


def _number(value: object) -> float:
    if not isinstance(value, (str, int, float)):
        raise PayloadError("not a number")
    try:
        return float(value)
    except (ValueError, OverflowError) as exc:
        raise PayloadError("not a number") from exc


def read_evidence(value: object) -> tuple[str, str | None, int | None, int | None] | None:
    """(chunk id, text, start, end): a chunk id with a bounded text or a non-empty range."""
    if value is None:
        return None
    if not isinstance(value, dict):
        raise PayloadError("evidence is no object")
    chunk = _text(value.get("chunk_id"))
    text = _first(value, "text", "evidence_text", "snippet")
    start, end = _first(value, "char_start", "source_start"), _first(value, "char_end", "source_end")
    text = None if text is None else _text(text)
    start, end = (None if x is None else _whole(x) for x in (start, end))
    ranged = start is not None and end is not None and end > start
    if not chunk.strip() or len(text or "") > EVIDENCE_MAX or not ((text or "").strip() or ranged):
        raise PayloadError("evidence names no place")
    return chunk, text, start, end


def read_entity(item: object) -> tuple:
    """(name, type, description, confidence, evidence)."""
    if not isinstance(item, dict):
        raise PayloadError("item is no object")
    description = _text(item["description"]) if "description" in item else ""
    return _text(item.get("name")), _text(item.get("type")), description, DEFAULT_CONFIDENCE, read_evidence(item.get("evidence"))


def read_relation(item: object) -> tuple:
    """(source, target, type, confidence, evidence)."""
    if not isinstance(item, dict):
        raise PayloadError("item is no object")
    confidence = _number(item["confidence"]) if "confidence" in item else DEFAULT_CONFIDENCE
    return _text(item.get("source")), _text(item.get("target")), _text(item.get("type")), confidence, read_evidence(item.get("evidence"))


def read_payload(raw: str | None) -> tuple[list[tuple], list[tuple]]:
    """(entities, relations) of a payload; raises ``PayloadError`` with the reason."""
    try:
        payload = json.loads(raw or "")
    except (ValueError, RecursionError) as exc:
        raise PayloadError("invalid JSON") from exc
    if not isinstance(payload, dict):
        raise PayloadError("extraction output must be a JSON object")
    for name in ("entities", "relations"):
        if name not in payload:
            raise PayloadError(f"missing required field: {name}")
        if not isinstance(payload[name], list):
            raise PayloadError(f"{name} must be a JSON array")
    out = []
    for name, kind, read in (("entities", "entity", read_entity), ("relations", "relation", read_relation)):
        try:
            out.append([read(item) for item in payload[name]])
        except PayloadError as exc:
            raise PayloadError(f"invalid {kind} payload") from exc
    return out[0], out[1]
