"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def suffix_dedup(docs, length=100):
    """docs: {doc_id: text} -> {doc_id: (n_bytes, n_removed, n_spans, kept)}"""
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                gone[i:i + length] = [True] * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, sha(kept))
    return out


def substring_dedup(docs, window=35):
    """docs: list of (doc_id, text) -> list of (doc_id, n_words, n_removed, sha)"""
    n = Counter()
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    for _, w in split:
        n.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, k=3):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def jaccard_components(docs, k=3, percent=90):
    """docs: {doc_id: text} -> {doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in docs}


def quality_counts(text):
    t = text or ""
    w = WORD.findall(t)
    n3 = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if n3[tuple(w[i:i + 3])] > 1:
            hit[i:i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": sum(hit),
    }
