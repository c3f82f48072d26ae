"""Plain, slow versions of the corpus operators."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\r\x0b\x0c"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def earlier_bytes(docs, width=100):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s:s + width]
            if w in seen:
                gone[s:s + width] = b"\1" * width
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def repeated_words(docs, width=35):
    count = Counter()
    for _, t in docs:
        w = words(t)
        count.update(tuple(w[s:s + width]) for s in range(len(w) - width + 1))
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if count[tuple(w[s:s + width])] > 1:
                gone[s:s + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def lines(docs, min_docs=10, min_chars=1, keep_first=False):
    def key(x):
        return x.strip(WHITE).translate(LOW)
    where = defaultdict(dict)
    for i, t in sorted(docs):
        for n, x in enumerate((t or "").split("\n")):
            where[key(x)].setdefault(i, n)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = []
        for n, x in enumerate(ls):
            k = key(x)
            bad = len(k) >= min_chars and len(where[k]) >= min_docs
            if not bad or (keep_first and (i, n) == min(where[k].items())):
                kept.append(x)
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def simhash(t):
    w = words((t or "").translate(LOW))
    sh = [" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """(id, fp) -> {id: smallest id reachable}."""
    distinct = sorted({f for _, f in fps})
    up = {f: f for f in distinct}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= 2:
                up[find(distinct[a])] = find(distinct[b])
    least = {}
    for i, f in sorted(fps):
        least.setdefault(find(f), i)
    return {i: least[find(f)] for i, f in fps}


def near(docs):
    fps = [(i, simhash(t)) for i, t in docs]
    c = components(fps)
    return [(i, f"{f:016x}", c[i]) for i, f in fps]


def shard_rows(docs, ids_of, end=2):
    out, start = [], 0
    for i, t in sorted(docs):
        ids = [*ids_of(t or ""), end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def nearest(rows, k=10, every=100):
    """rows: (id, vector) all usable."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = []
    for i, v in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out += [(int(i), r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order)]
    return out


def leaks(docs, items, similarity=0.8):
    def shingles(w):
        return Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4)))
    out = set()
    for item, t in items:
        b = re.findall(r"\w+", (t or "").lower())
        if not b:
            continue
        want = shingles(b)
        for i, d in docs:
            w = re.findall(r"\w+", (d or "").lower())
            if not w:
                continue
            n = min(len(b), len(w))
            for s in range(len(w) - n + 1):
                have = shingles(w[s:s + n])
                share = sum((have & want).values())
                if share / (sum(have.values()) + sum(want.values()) - share) >= similarity:
                    out.add((i, item))
                    break
    return sorted(out)


def similar(docs, least=0.8):
    """{id: smallest id reachable} over pairs whose sets of five-word shingles have this Jaccard similarity."""
    sets = []
    for i, t in docs:
        w = words((t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s == t or min(len(s), len(t)) >= least * max(len(s), len(t)) and len(s & t) / len(s | t) >= least:
                up[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        low[find(a)] = min(i, low.get(find(a), i))
    return {i: low[find(a)] for a, (i, _) in enumerate(sets)}
