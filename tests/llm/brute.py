"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash


def removed_bytes(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """Per text: bytes, removed bytes, removed runs, hash of the rest."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list[int | None], prints: list[int]) -> list[int | None]:
    group = list(range(len(ids)))

    def root(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                group[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(ids)):
        members[root(i)].append(ids[i])
    return [min((x for x in members[root(i)] if x is not None), default=None) for i in range(len(ids))]


def words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contamination(texts: list[str | None], items: list[tuple[int | None, str | None]], width: int = 10):
    """Per text: words, hit words, sorted item ids."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end)."""
    out = []
    for place, (kind, expression) in enumerate(EXPRESSIONS.items(), 1):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), place, kind, m.end()))
    return sorted(out)


def lines_kept(rows: list[tuple[int | None, str | None]], width: int = 3) -> dict:
    """(id, text) to (kept text, lines, removed lines)."""
    first: dict[tuple, tuple] = {}
    texts = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    covered = defaultdict(set)
    for row in texts:
        lines = row[1].split("\n")
        for i in range(len(lines) - width + 1):
            window = tuple(lines[i : i + width])
            if first.setdefault(window, (row, i)) != (row, i):
                covered[row].update(range(i, i + width))
    out = {}
    for row in set(rows):
        if row[1] is None:
            out[row] = (None, 0, 0)
            continue
        lines = row[1].split("\n")
        out[row] = ("\n".join(x for i, x in enumerate(lines) if i not in covered[row]), len(lines), len(covered[row]))
    return out


def top_k(vectors: list[tuple[int | None, list | None]], k: int = 5, every: int = 50) -> list[tuple[int, int, int, int]]:
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(good):
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(good) if m != n)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)
