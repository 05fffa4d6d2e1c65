"""Plain versions of the operators, one row at a time."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = {c: c + 32 for c in range(65, 91)}


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def simhash(text, n):
    words = space_words(text)
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, v in votes.items() if 2 * v > len(shingles))


def least_reachable(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            label[n] = label[label[n]]
            n = label[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def contamination(text, items, window=10):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        iw = plain_words(item)
        n = min(window, len(iw))
        for a in range(len(iw) - n + 1) if iw else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == iw[a : a + n]:
                    hit.update(range(p, p + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)
