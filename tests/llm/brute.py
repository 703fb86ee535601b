"""Plain versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def joined(found: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))


def pii(text: str | None) -> tuple:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == 3 or luhn(d)):
                found.append((m.start(), kind, m.end()))
    return (*[sum(f[1] == k for f in found) for k in range(4)], sha(joined(found, ["email", "ip", "card", "phone"])))


def secrets(text: str | None) -> tuple:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return (*[sum(f[1] == k for f in found) for k in range(3)], sha(joined(found, ["assign", "access", "hex"])))


def redacted(text: str | None) -> str:
    """The text without its base secrets; what overlaps goes as one."""
    text = text or ""
    found = [m.span() for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20] + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    out, at = [], 0
    for a, b in sorted(found):
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def copies(doc_id: int | None, text: str | None, rate: float, seed: str) -> int:
    """The Poisson number of a document."""
    ident = str(doc_id) if doc_id is not None else hashlib.md5((text or "").encode()).hexdigest()
    u = int(hashlib.md5(f"{seed}:{ident}".encode()).hexdigest()[:13], 16) / 2**52
    k, c = 0, math.exp(-rate)
    p = c
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def quality(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeat = len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)})
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in "".join(words)), dup, repeat, n < 10 or 100 * repeat > 20 * n


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0
