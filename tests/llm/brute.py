"""Plain Python forms of the text operators, for small tables."""

import bisect
import re
import zlib
from collections import Counter

import pyarrow as pa

from quarrylane.llm.common import tokens

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(docs, size, num, den):
    """docs: list of (doc_id, text), ids unique and not null."""
    sets = {d: shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def units(text):
    out, cur = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if cur and "\n" in text[cur[-1][1] : m.start()]:
            out.append(cur)
            cur = []
        cur.append((m.start(), m.end()))
        if text[m.end() - 1] in ".!?":
            out.append(cur)
            cur = []
    cut = []
    for u in out + [cur] if cur else out:
        cut.append([])
        hashes = tokens(pa.array([" ".join(text[a:b] for a, b in u)])).hashes
        for i, (w, h) in enumerate(zip(u, hashes)):
            cut[-1].append(w)
            if len(u) >= 16 and int(h) % 8 == 0 and i + 1 < len(u):
                cut.append([])
    return cut


def dedup(docs, min_words, min_line_words=None):
    """{doc_id: (text left, [(start, end, kept)])} for what loses something; docs: {doc_id: text}."""
    seen, res = {}, {}
    for k in sorted(docs):
        t = docs[k]
        us = units(t)
        breaks = [m.start() for m in re.finditer("\n", t)]
        lines = [bisect.bisect_left(breaks, u[0][0]) for u in us]
        sizes = Counter(lines)
        gone = []
        for i, u in enumerate(us):
            key = tuple(t[a:b].translate(LOWER) for a, b in u)
            if key in seen:
                gone.append((i, len(u), seen[key]))
            else:
                seen[key] = k
        spans, p = [], 0
        while p < len(gone):
            q = p
            while q + 1 < len(gone) and gone[q + 1][0] == gone[q][0] + 1:
                q += 1
            run = gone[p : q + 1]
            parts = [run] if sum(x[1] for x in run) >= min_words else []
            if not parts and min_line_words:
                for n in sorted({lines[x[0]] for x in run}):
                    own = [x for x in run if lines[x[0]] == n]
                    if len(own) == sizes[n] and sum(x[1] for x in own) >= min_line_words:
                        parts.append(own)
            for own in parts:
                nxt = own[-1][0] + 1
                spans.append((us[own[0][0]][0][0], us[nxt][0][0] if nxt < len(us) else len(t), own[0][2]))
            p = q + 1
        if spans:
            left, at = "", 0
            for a, b, _ in spans:
                left, at = left + t[at:a], b
            res[k] = (left + t[at:], spans)
    return res


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod
