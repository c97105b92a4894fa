"""Path dialects of the tree-shaped formats, compiled on the driver.

A malformed path is a ValueError before any job starts; a path that matches
nothing is NULL at run time.
"""

from __future__ import annotations

import json
import re

_CSV = re.compile(r"R(?:\[([1-9]\d*)\])?(?:\.([1-9]\d*))?")


def csv_path(path: str) -> tuple[int, int]:
    """(row, column), 0 where not written."""
    m = _CSV.fullmatch(path)
    if m is None:
        raise ValueError(f'csv: invalid path "{path}" (expected R[row].col)')
    return int(m[1] or 0), int(m[2] or 0)


_JSON_STEP = re.compile(
    r"""\[(?P<idx>0|[1-9]\d*)\]"""
    r"""|\[(?P<dq>"(?:[^"\\]|\\.)*")\]"""
    r"""|\['(?P<sq>(?:[^'\\]|\\.)*)'\]"""
    r"""|(?P<dot>\.?)(?P<key>[^.\[]+)""", re.S)


def json_steps(path: str) -> list[str | int]:
    """Keys as str and 0-based array indexes as int."""
    if not path:
        raise ValueError("json: empty path")
    steps, at = [], 0
    while at < len(path):
        m = _JSON_STEP.match(path, at)
        if m is None or (m["key"] is not None and bool(m["dot"]) != bool(steps)):
            raise ValueError(f'json: invalid path "{path}"')
        if m["idx"] is not None:
            steps.append(int(m["idx"]))
        elif m["dq"] is not None:
            try:
                steps.append(json.loads(m["dq"]))
            except ValueError as e:
                raise ValueError(f'json: invalid path "{path}": {e}') from None
        elif m["sq"] is not None:
            steps.append(re.sub(r"\\(.)", r"\1", m["sq"], flags=re.S))
        else:
            steps.append(m["key"])
        at = m.end()
    return steps


def json_key_text(path: str, key: str) -> str:
    """Append a key in dialect form, quoting path metacharacters."""
    if key == "" or any(c in key for c in '.[]"'):
        return f"{path}[{json_string(key)}]"
    return f"{path}.{key}" if path else key


def json_string(s: str) -> str:
    text = json.dumps(s, ensure_ascii=False)
    return text.replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def json_pattern(path: str) -> str:
    """Regular expression over flattened node paths.

    A key step fans out over the elements of an array one level deep, and a
    path ending on an array stands for its elements."""
    out, after_key = "", False
    for i, step in enumerate(json_steps(path)):
        if isinstance(step, int):
            out += rf"\[{step}\]"
        else:
            text = json_key_text("" if i == 0 else "x", step)
            out += (r"(?:\[\d+\])?" if after_key else "") + re.escape(text if i == 0 else text[1:])
        after_key = not isinstance(step, int)
    return out


def xml_steps(path: str) -> list[tuple[str, int, bool]]:
    """(name, occurrence or 0, is attribute) per step."""
    orig, path = path, path.removeprefix("/")
    if not path:
        raise ValueError("xml: empty path")
    parts, steps = path.split("/"), []
    for i, part in enumerate(parts):
        if part.startswith("@"):
            if not re.fullmatch(r"@[^\[\]@]+", part):
                raise ValueError(f'xml: invalid path "{orig}": bad attribute step "{part}"')
            if i != len(parts) - 1:
                raise ValueError(f'xml: invalid path "{orig}": {part} must be the final step')
            steps.append((part[1:], 0, True))
            continue
        m = re.fullmatch(r"([^\[\]@]+)(?:\[([1-9]\d*)\])?", part)
        if m is None:
            raise ValueError(f'xml: invalid path "{orig}": bad step "{part}"')
        steps.append((m[1], int(m[2] or 0), False))
    return steps


def xml_pattern(path: str) -> str:
    """Regular expression over flattened node paths; first occurrences are
    written without an index there."""
    parts = []
    for name, occ, is_attr in xml_steps(path):
        text = re.escape(("@" if is_attr else "") + name)
        if not is_attr and occ == 0:
            text += r"(?:\[\d+\])?"
        elif occ > 1:
            text += rf"\[{occ}\]"
        parts.append(text)
    return "/".join(parts)
