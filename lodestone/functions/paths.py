"""Field paths: ``a.b.0.c`` and ``a.b[0].c`` name the same place."""

from __future__ import annotations

import re
from functools import lru_cache

Segment = str | int
PART = re.compile(r"([^.\[\]]+)|\[(\d+)\]|(\.)")


@lru_cache(maxsize=4096)
def parse(path: str) -> tuple[Segment, ...]:
    """Segments of a path; whole numbers after the first segment are array places."""
    if not path:
        raise ValueError("empty field path")
    out: list[Segment] = []
    at = 0
    after_dot = True
    while at < len(path):
        m = PART.match(path, at)
        if not m or (m[3] and after_dot) or (m[1] and not after_dot) or (m[2] is not None and not out):
            raise ValueError(f"bad field path {path!r}")
        if m[1]:
            out.append(int(m[1]) if out and m[1].isdigit() else m[1])
        elif m[2] is not None:
            out.append(int(m[2]))
        after_dot = bool(m[3])
        at = m.end()
    if after_dot:
        raise ValueError(f"bad field path {path!r}")
    return tuple(out)


def variant_path(segments: tuple[Segment, ...]) -> str:
    """The path in Spark's variant notation, every key quoted."""
    parts = ["$"]
    for s in segments:
        if isinstance(s, int):
            parts.append(f"[{s}]")
        elif "'" not in s:
            parts.append(f"['{s}']")
        elif '"' not in s:
            parts.append(f'["{s}"]')
        else:
            raise ValueError(f"a key cannot hold both kinds of quotes: {s!r}")
    return "".join(parts)
