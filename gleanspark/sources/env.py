"""Settings from files of KEY=VALUE lines."""

from __future__ import annotations

import os
import re
from collections.abc import MutableMapping

_LINE = re.compile(r"(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)", re.DOTALL)


def parse_env(text: str) -> dict[str, str]:
    """Values by key: blank lines and those that begin with # don't count, ``export`` may come first, a pair of quotes around a value goes."""
    out: dict[str, str] = {}
    for number, line in enumerate(text.removeprefix("﻿").splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = _LINE.fullmatch(line)
        if not m:
            raise ValueError(f"line {number} is no KEY=VALUE")
        value = m[2].strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[m[1]] = value
    return out


def load_env(path: str, into: MutableMapping[str, str] = os.environ) -> dict[str, str]:
    """Sets what a file names and ``into`` doesn't have yet; a missing file is none. Returns what was set."""
    try:
        with open(path, encoding="utf-8") as f:
            found = parse_env(f.read())
    except FileNotFoundError:
        return {}
    new = {k: v for k, v in found.items() if k not in into}
    into.update(new)
    return new
