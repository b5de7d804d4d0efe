"""Plain, slow versions of what the operators compute, on Python lists."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (4, "one two three", "en", "a", 13), (4, "one two three", "en", "a", 13),
    (None, "no id here", "en", "b", 10), (5, "word " * 60_000, "en", "b", 300_000), (6, "Ünïcödé mail a.b@c.de +1 (383) 555-6083", "de", "z", 40),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def base_rules(text):
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {j for k, g in enumerate(grams) if seen[g] > 1 for j in (k, k + 1, k + 2)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def fill_targets(sizes, weights=(5, 2, 1)):
    """Targets by source: shared by weight, capped at three times the size, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if part[s] > 3 * sizes[s]]
        if not over:
            return part | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def personal(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(c if j % 2 == 0 else (2 * c if c < 5 else 2 * c - 9) for j, c in enumerate(reversed(d))) % 10 == 0
            ok = [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def forward_backward(odds, trans):
    """Marginals of state 1 of one chain, by summing over all state sequences' weights step by step."""
    if not len(odds):
        return []
    e = [(1.0, math.exp(o)) for o in odds]
    f = [[e[0][0], e[0][1]]]
    for k in range(1, len(e)):
        row = [sum(f[-1][i] * math.exp(trans[i][j]) for i in (0, 1)) * e[k][j] for j in (0, 1)]
        f.append([x / sum(row) for x in row])
    b = [[1.0, 1.0]]
    for k in range(len(e) - 1, 0, -1):
        row = [sum(math.exp(trans[i][j]) * e[k][j] * b[0][j] for j in (0, 1)) for i in (0, 1)]
        b.insert(0, [x / sum(row) for x in row])
    return [x[1] * y[1] / (x[0] * y[0] + x[1] * y[1]) for x, y in zip(f, b, strict=True)]
