"""Plain versions of the operators, for tests only."""

from __future__ import annotations

import re
from collections import defaultdict


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def near_components(rows, k, num, den):
    """{doc_id: (set size, component)} over all pairs."""
    sets = {d: shingles(t, k) for d, t in rows}
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def secrets(text):
    """(start, kind number, end) of the base kinds, by the letter of their definition."""
    t = text or ""
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def tiles(a, b, least):
    """Greedy string tiling by looking at every pair of positions."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and not ma[i + k] and not mb[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        for n in range(k):
            ma[i + n] = mb[j + n] = True
        out.append((i, j, k))


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return {d: (max(groups[t or ""]), len(groups[t or ""])) for d, t in rows}


def addresses(text):
    """E-mail and IPv4 addresses among the words of a text."""
    out = []
    for w in (text or "").split():
        w = w.strip(".,;:!?*#%$&()\"'")
        parts = w.split(".")
        if w.count("@") == 1 and w.isascii() and w[0].isalnum() and "." in w.split("@")[1] and parts[-1].isalpha() and len(parts[-1]) >= 2:
            out.append(w)
        elif len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) < 256 and (p == "0" or p[0] != "0") for p in parts):
            out.append(w)
    return out
