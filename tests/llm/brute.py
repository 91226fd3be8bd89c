"""Plain versions of the operators, row by row, for small inputs."""

import hashlib
import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOW)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(text):
    words = WORDS.findall(low(text))
    hits = []
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def shingles(text, k=3):
    words = BLANKS.findall(low(text))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(sets, percent=90):
    """sets: {id: set}; the smallest id that links reach."""
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {x: find(x) for x in ids}


def windows(text, items, n=10):
    """Number of words, hit words and the items of a text."""
    words, hit, found = WORDS.findall(low(text)), set(), set()
    for item_id, body in items:
        w = WORDS.findall(low(body))
        m = min(n, len(w))
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in grams:
                hit.update(range(i, i + m))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)
