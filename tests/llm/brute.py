"""Plain Python versions of the text operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(A_Z))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def copies(rows):
    """{doc_id: (keep_id, group size, digest)} of (doc_id, text) with different ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {x[3]: (min(g)[3], len(g), sha(body)) for body, g in groups.items() for x in g}


def contamination(docs, items, length=10):
    """{doc_id: (words, hit words, item ids)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(length, len(w))
        for s in range(len(w) - size + 1) if size else ():
            windows[tuple(w[s : s + size])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[s : s + size])):
                    hit.update(range(s, s + size))
                    found |= ids
        out[i] = (len(w), len(hit), sorted((x for x in found if x is not None), key=str))
    return out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def clusters(rows, least=0.8):
    """{doc_id: smallest id of its component} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and len(a & b) >= least * len(a | b) - 1e-9:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    text = text or ""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    found = [(m.start(), n, kind, m.end()) for n, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]
    return [(k, s, e) for s, _, k, e in sorted(found)]
