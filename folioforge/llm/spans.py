"""Marked places in a text, as (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from collections import Counter

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by kind as listed, then by end; each once."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def counts(spans: list[Span]) -> Counter:
    return Counter(k for k, _, _ in spans)


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that any span covers, apart from each other and in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def replaced(text: str, spans: list[Span], by: str) -> str:
    at, out = 0, []
    for a, b in merged(spans):
        out += [text[at:a], by]
        at = b
    return "".join([*out, text[at:]])
