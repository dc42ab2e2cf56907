"""JavaScript regular expressions for Java's engine."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

FLAGS = {"i": "i", "m": "m", "s": "s"}


def flags_of(pattern: re.Pattern) -> str:
    """The option letters of a compiled Python pattern."""
    return "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & f)


def to_java(pattern: str, options: str = "") -> str:
    """``$`` without the m flag is the very end; ``[^]`` is any character and ``[]`` none; options become inline flags."""
    unknown = set(options) - {"i", "m", "s", "g", "u", "x", "y"}
    if unknown:
        raise ValueError(f"unknown regular expression options {sorted(unknown)}")
    multiline, out, i, in_class = "m" in options, [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" else "&&".replace("&", "\\&") if pattern.startswith("&&", i) else c)
            i += 2 if pattern.startswith("&&", i) else 1
            continue
        if pattern.startswith("[^]", i):
            out.append(r"[\s\S]")
            i += 3
            continue
        if pattern.startswith("[]", i):
            out.append(r"(?!)")
            i += 2
            continue
        if c == "[":
            in_class = True
        out.append(r"\z" if c == "$" and not multiline else c)
        i += 1
    inline = "".join(FLAGS[o] for o in dict.fromkeys(options) if o in FLAGS)
    return (f"(?{inline})" if inline else "") + "".join(out)


def compiles(java_pattern: str) -> bool:
    """Whether Java accepts the pattern (asked on the driver, once per query)."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_pattern)
    except Exception:
        return False
    return True
