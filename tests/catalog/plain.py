"""Row-wise matching, for a second opinion on small inputs."""

import re

COMMON = {"the", "a", "an", "and", "or", "of", "in", "on", "at", "by", "for", "with"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def close(a, b):
    return (1 - edits(a, b) / max(len(a), len(b))) * 100 if a or b else 0.0


def norm(c):
    c = (c or "").strip().lower()
    return None if c in ("", "unknown", "uncategorized", "none", "n/a", "na") else c


def sku(a, b):
    a, b = (a or "").strip().upper(), (b or "").strip().upper()
    return 0.0 if not a or not b else 100.0 if a == b else 0.0 if abs(len(a) - len(b)) > 5 else close(a, b)


def name(a, b):
    if not (a or "").strip() or not (b or "").strip():
        return 0.0
    a, b = (" ".join(w for w in re.sub(r"[^\w\s]", " ", x.strip().lower()).split() if w not in COMMON) for x in (a, b))
    if a == b:
        return 100.0
    x, y = set(a.split()), set(b.split())
    if x and y:
        both = len(x & y)
        if (j := both / len(x | y) * 100) >= 50:
            return j
        if both >= min(len(x), len(y)) * 0.7:
            return both / min(len(x), len(y)) * 100
    return close(a, b)


def category(a, b):
    a, b = norm(a), norm(b)
    if a is None and b is None:
        return 50.0
    if a is None or b is None:
        return 0.0
    return 100.0 if a == b else close(a, b) if edits(a, b) <= 2 else 0.0


def price(a, b):
    return 50.0 if not a or not b or a <= 0 or b <= 0 else max(0.0, 100 - abs(a - b) / ((a + b) / 2) * 100)


def sales(a, b):
    if a is None or b is None or a == b == 0:
        return 50.0
    return 25.0 if a == 0 or b == 0 else min(a, b) / max(a, b) * 100


def metadata(queries, catalog, limit=10):
    """(new, matched, score) of the best candidates; rows: id, sku, product_name, category, price, sales."""
    out = []
    for q in queries:
        found = []
        for c in catalog:
            if q["id"] == c["id"] or norm(q["category"]) and norm(c["category"]) and norm(q["category"]) != norm(c["category"]):
                continue
            parts = [(sku(q["sku"], c["sku"]), 0.30, 40), (name(q["product_name"], c["product_name"]), 0.30, 50), (category(q["category"], c["category"]), 0.25, 50), (price(q["price"], c["price"]), 0.10, 60), (sales(q["sales"], c["sales"]), 0.05, 60)]
            found.append((-sum(s * w if s >= t else s * w * 0.5 for s, w, t in parts), c["id"]))
        out += [(q["id"], i, -s) for s, i in sorted(found)[:limit]]
    return out
