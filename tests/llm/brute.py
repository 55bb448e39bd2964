"""Plain Python versions of the queries, for small tables given as lists of tuples."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def token_files(docs, tokenizer_path, end_id=2):
    """docs (doc_id, text) -> doc_id, start, n_tokens, crc32."""
    import numpy as np
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(tokenizer_path), 0, []
    for d, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((d, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def contamination(docs, items, size=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, text in items:
        w = find(text)
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                windows[tuple(w[k : k + size])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, found = find(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        joined = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def proximity(docs, items, size=13, slop=8, anchors=3):
    """Per document, in order, the sorted items with a window whose rarest words are all near their places."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    texts = [find(t) for _, t in docs]
    count = defaultdict(int)
    for w in texts:
        for x in w:
            count[x] += 1
    out = [set() for _ in docs]
    for i, text in items:
        w = find(text)
        for k in range(max(1, len(w) - size + 1) if i is not None and w else 0):
            g = w[k : k + size]
            if not all(x in count for x in g):
                continue
            rare = sorted(set(g), key=lambda x: (count[x], x))[:anchors]
            for d, t in enumerate(texts):
                lists = [{p - o for p, y in enumerate(t) if y == x for o, z in enumerate(g) if z == x} for x in rare]
                if any(all(any(abs(b - a) <= slop for b in more) for more in lists[1:]) for a in lists[0]):
                    out[d].add(str(i))
    return [sorted(x) for x in out]


def near_duplicates(docs, words=5):
    """docs (doc_id, text), ids distinct -> doc_id, n_shingles, component, kept."""
    sets = {}
    for d, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
        k = min(words, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = defaultdict(int)
    for ids in where.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def targets(sizes, weights=(1, 2, 3), cap=3):
    """source -> target, by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    open_ = list(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return full | {s: left * w[s] / total for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
        left -= sum(full[s] for s in over)
        open_ = [s for s in open_ if s not in full]
    return full


def fingerprint(text, short=48):
    """The Merkle tree of a text, written as text."""
    h = lambda x: hashlib.md5(x.encode()).hexdigest()[:16]
    paragraphs, at = [], 0
    while at < len(text):
        end = text.find("\n", min(at + short, len(text)))
        end = len(text) if end < 0 else end + 1
        paragraphs.append(text[at:end])
        at = end
    leaves = [[h(x) for x in re.findall(rf"[^.!?\n]{{1,{short}}}[.!?\n]*|[.!?\n]+", p)] for p in paragraphs]
    sections = [""]
    for node in (h("".join(x)) for x in leaves):
        sections[-1] += node
        if node[-1] in "08":
            sections.append("")
    sections = [x for x in sections if x]
    sketch = sorted({x for y in leaves for x in y})[:64]
    root = hashlib.sha256("".join(map(h, sections)).encode()).hexdigest()
    return "|".join([root, *(f"{h(x)}:{x}" for x in sections), "~" + "".join(sketch)])


def likeness(a, b):
    x, y = (set(re.findall(".{16}", f.split("~")[1])) for f in (a, b))
    first = sorted(x | y)[:64]
    if not first:
        return 1.0
    share = sum(h in x and h in y for h in first) / len(first)
    return 2 * share / (1 + share)
