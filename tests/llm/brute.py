"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    found = WORD.findall(lower(text or ""))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} or ({tuple(found)} if found else set())


def components(nodes, links) -> dict:
    """Smallest node reachable from each."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
