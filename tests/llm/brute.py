"""Plain versions of the contracts, for small inputs."""

import hashlib
import re
from collections import defaultdict


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(key, keep, len(members), key == keep, sha(norm)) for _, key in members]
    return sorted(out)


def decontaminate(rows, items, size=13):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, text in items:
        w = re.findall(word, low(text))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in rows:
        w = re.findall(word, low(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = sorted(map(str, found))
        out.append((key, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def shingles(text, k):
    w = spaced(low(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k=4, percent=85):
    sets = {key: shingles(text, k) for key, text in rows}
    keys = sorted(sets)
    root = {x: x for x in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for x in keys:
        for s in sets[x]:
            by[s].append(x)
    pairs = {(a, b) for members in by.values() for a in members for b in members if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((x, len(sets[x]), find(x)) for x in keys)


def repeats(rows, size=20):
    """doc, n_words, removed places: words in a window that also starts earlier."""
    seen, out = set(), []
    for key, text in sorted(rows):
        w = spaced(text)
        gone = set()
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        out.append((key, w, gone))
    return out


def links(rows, k=4, percent=85):
    """Of each document, how many different sets its own links with."""
    sets = {key: frozenset(shingles(text, k)) for key, text in rows}
    different = sorted({s for s in sets.values() if s}, key=len)
    found = defaultdict(int)
    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                found[a] += 1
                found[b] += 1
    return sorted((key, found[s]) for key, s in sets.items())
