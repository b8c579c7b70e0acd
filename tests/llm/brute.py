"""Plain versions of the corpus operators, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = list(zip(words, words[1:], words[2:]))
    counts = Counter(runs)
    inside = {i + k for i, run in enumerate(runs) if counts[run] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= width:
        return frozenset(zip(*(words[k:] for k in range(width))))
    return frozenset([tuple(words)] if words else [])


def components(rows, width, percent):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}
