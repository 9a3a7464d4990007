"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def runs(flags):
    """Maximal runs of set flags."""
    found, start = [], None
    for i, flag in enumerate([*flags, False]):
        if flag and start is None:
            start = i
        elif not flag and start is not None:
            found.append((start, i))
            start = None
    return found


def repeats(sequences, length, keep_first=False):
    """For every sequence the flags of the tokens to remove."""
    windows = lambda s: [s[i : i + length] for i in range(len(s) - length + 1)]
    counts, seen, found = Counter(w for s in sequences for w in windows(s)), set(), []
    for s in sequences:
        flags = [False] * len(s)
        for i, w in enumerate(windows(s)):
            if w in seen if keep_first else counts[w] > 1:
                flags[i : i + length] = [True] * length
            seen.add(w)
        found.append(flags)
    return found


def suffix_rows(rows, length):
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), text, flags in zip(rows, texts, repeats(texts, length)):
        kept = bytes(b for b, f in zip(text, flags) if not f)
        out.append((doc_id, len(text), sum(flags), len(runs(flags)), sha(kept)))
    return out


def substring_rows(rows, length):
    """``doc_id, n_words, n_removed, kept_sha256``."""
    texts = [tuple((t or "").encode().split()) for _, t in rows]
    out = []
    for (doc_id, _), words, flags in zip(rows, texts, repeats(texts, length)):
        kept = b" ".join(w for w, f in zip(words, flags) if not f)
        out.append((doc_id, len(words), sum(flags), sha(kept)))
    return out


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_rows(rows, size=2, percent=80):
    """``doc_id, n_shingles, component_id, kept``."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    members = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(root(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        least = min((d for d in members[root(i)] if d is not None), default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return out


def secret_rows(rows):
    """``doc_id, n_assign, n_access, n_hex, base_sha256``."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = []
    for doc_id, text in rows:
        text, found = text or "", []
        found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        found.sort()
        spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
        out.append((doc_id, *(sum(f[1] == k for f in found) for k in range(3)), sha(spans.encode())))
    return out


def top_rows(rows, asks, k):
    """``query_id, rank, vec_id, score``."""
    out = []
    for q, v in rows:
        if asks(q):
            scores = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q), key=lambda x: (-x[0], x[1]))
            out += [(q, r, i, s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def edit_distance_in(segment: bytes, text: bytes) -> int:
    """Fewest edits between ``segment`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(segment, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)
