"""Plain versions of what the operators find."""

import zlib


def crc32(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


class Sets:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def document_components(texts, n, percent=80):
    """texts: id to text. Returns id to (set size, component)."""
    sets, groups = {k: shingles(t, n) for k, t in texts.items()}, Sets(texts)
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                groups.join(a, b)
    return {k: (len(sets[k]), groups.find(k)) for k in keys}


def line_places(texts, min_words=5, chars=8, percent=80):
    """texts: id to text. Returns (id, line) to the place that stays for it."""
    places, first = {}, {}
    for k in sorted(texts):
        for i, line in enumerate((texts[k] or "").encode().split(b"\n")):
            words = line.lower().split()
            if len(words) >= min_words:
                places[k, i] = b" ".join(words)
                first.setdefault(places[k, i], (k, i))
    cut = lambda x: {x[i : i + chars] for i in range(max(1, len(x) - chars + 1))}
    sets, groups = {x: cut(x) for x in first}, Sets(first.values())
    lines = list(first)
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                groups.join(first[a], first[b])
    return {p: groups.find(first[x]) for p, x in places.items()}
