"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

INF = float("inf")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def key(doc_id):
    return INF if doc_id is None else doc_id


# ---- op1 ----------------------------------------------------------------------

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            v = m.group()
            digits = re.sub("[^0-9]", "", v)
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")),
                  "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def redact(text, spans) -> str:
    out, at = "", 0
    for s, _, e, kind in sorted((s, -e, e, k) for k, s, e in spans):
        if s >= at:
            out += text[at:s] + f"[{kind.upper()}]"
        at = max(at, e)
    return out + text[at:]


# ---- op3 ----------------------------------------------------------------------

def plain_words(text) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contained(text, items) -> tuple[int, int, list[str]]:
    """Words, hit words, sorted ids of the items with a window in the text."""
    words = plain_words(text)
    hit, found = set(), set()
    for name, item in items:
        own = plain_words(item)
        n = min(10, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(found)


# ---- op5, op8 -------------------------------------------------------------------

def covered(units: list[list], ids: list, window: int) -> list[list[bool]]:
    """Units under a window that also starts in a document with a smaller id."""
    first: dict = {}
    for u, d in zip(units, ids, strict=True):
        for i in range(len(u) - window + 1):
            w = tuple(u[i:i + window])
            first[w] = min(first.get(w, INF), key(d))
    out = []
    for u, d in zip(units, ids, strict=True):
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if first[tuple(u[i:i + window])] < key(d):
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- op9 ----------------------------------------------------------------------

def shingles(text) -> set:
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def classes(rows: list[tuple]) -> list[tuple]:
    """(class_id, links, place of the kept row) of each (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and bool(sets[j])
             and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i]] + [label[j] for j in range(n) if link[i][j]])
            changed |= low != label[i]
            label[i] = low
    out = []
    for i in range(n):
        own = [j for j in range(n) if label[j] == label[i]]
        least = min(key(rows[j][0]) for j in own)
        out.append((None if least == INF else least, sum(link[i])))
    return out
