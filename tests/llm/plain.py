"""Plain programs that the operators are compared with."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, distance=4):
    """Smallest id reachable, for rows of (id, fingerprint), by comparing all pairs."""
    prints = sorted({f for _, f in rows})
    values, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance):
            parent[find(i)] = find(i + 1 + int(j))
    place, least = {f: i for i, f in enumerate(prints)}, {}
    for d, f in rows:
        root = find(place[f])
        if d is not None:
            least[root] = min(least.get(root, d), d)
    return [least.get(find(place[f])) for _, f in rows]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def contamination(docs, items):
    """(n_words, n_hit, item ids) of each text, by looking up every window of it."""
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(str(item))
    sizes, out = sorted({len(k) for k in windows}), []
    for text in docs:
        words = words_of(text)
        hit, found = [False] * len(words), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if items_ := windows.get(tuple(words[k : k + n])):
                    found |= items_
                    hit[k : k + n] = [True] * n
        out.append((len(words), sum(hit), sorted(found)))
    return out


def hashed(ids):
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def least_cost(places, penalties, limit):
    """Least cost of cutting at some of the places, by trying every earlier place."""
    cost = [0]
    for j in range(1, len(places)):
        best = None
        for i in range(j):
            size = places[j] - places[i]
            if size <= limit:
                c = cost[i] + (0 if size & (size - 1) == 0 else limit - size)
                best = c if best is None or c < best else best
        cost.append(best + penalties[j])
    return cost[-1]
