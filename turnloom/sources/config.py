"""Settings: the YAML that configuration files use (nested keys, lists of scalars, scalars)."""

from __future__ import annotations

from typing import Any


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    words = {"": None, "null": None, "~": None, "true": True, "false": False}
    if text.lower() in words:
        return words[text.lower()]
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _without_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if c in "\"'":
            quote = "" if quote == c else quote or c
        elif c == "#" and not quote and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def settings(text: str) -> dict[str, Any]:
    """A mapping from the text of a configuration file; raises ValueError for what it doesn't know."""
    lines = [x for x in map(_without_comment, text.splitlines()) if x.strip() and x.strip() != "---"]
    out, rest = _block(lines, 0)
    if rest:
        raise ValueError(f"not understood: {rest[0]!r}")
    return out if isinstance(out, dict) else {}


def _block(lines: list[str], indent: int) -> tuple[Any, list[str]]:
    found: Any = None
    while lines:
        width = len(lines[0]) - len(lines[0].lstrip())
        body = lines[0].strip()
        if width < indent:
            break
        if width > indent:
            raise ValueError(f"not understood: {lines[0]!r}")
        lines = lines[1:]
        if body.startswith("- "):
            found = [] if found is None else found
            found.append(_scalar(body[2:]))
            continue
        key, colon, value = body.partition(":")
        if not colon or isinstance(found, list):
            raise ValueError(f"not understood: {body!r}")
        found = {} if found is None else found
        if value.strip() or not lines:
            found[_scalar(key)] = _scalar(value)
            continue
        inner = len(lines[0]) - len(lines[0].lstrip())
        if inner > indent or (inner == indent and lines[0].lstrip().startswith("- ")):
            found[_scalar(key)], lines = _block(lines, inner)
        else:
            found[_scalar(key)] = None
    return found, lines
