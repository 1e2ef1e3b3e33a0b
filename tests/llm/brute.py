"""Plain Python answers to the operators' questions, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def exact(rows):
    """{doc_id: (keep_id, group_size, kept, sha)} for rows of distinct doc_id."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    return {
        d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g
    }


def near(rows, k, percent):
    """{doc_id: (size of its set, smallest doc_id reachable)}."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    seen = {}
    for d in ids:
        seen.setdefault(sets[d], d)
        root[find(d)] = find(seen[sets[d]])
    reps = sorted(seen.values())
    for i, a in enumerate(reps):
        for b in reps[:i]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) and shared:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for d in sorted(sets):
        least.setdefault(find(d), d)
    return {d: (len(sets[d]), least[find(d)]) for d in sets}


def repeats(rows, length):
    """{doc_id: (bytes, removed, spans, kept)} for rows of distinct doc_id."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], doc)
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g))
    return out


def backoff_scores(rows, order, backoff):
    """{doc_id: (words, log score, words at full history)}."""
    texts = {d: words(t) for d, t in rows}
    own = {d: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for d, w in texts.items()}
    every = sum(own.values(), Counter())
    total, vocabulary = sum(map(len, texts.values())), sum(len(g) == 1 for g in every)
    out = {}
    for d, w in texts.items():
        count = lambda g, d=d: every[tuple(g)] - own[d][tuple(g)]
        score, full = 0.0, 0
        for i in range(len(w)):
            most = k = min(i, order - 1)
            while k and count(w[i - k : i + 1]) <= 0:
                k -= 1
            share = count(w[i - k : i + 1]) / count(w[i - k : i]) if k else (count(w[i : i + 1]) + 1) / (total - len(w) + vocabulary + 1)
            score += math.log(share) + (most - k) * math.log(backoff)
            full += k == most
        out[d] = (len(w), score, full)
    return out


def secret_spans(text):
    """[(start, place, end)] of the base rules, by plain regular expressions."""
    rules = [
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), p, m.end()) for p, (r, f, ok) in enumerate(rules) for m in re.finditer(r, text or "", f) if ok(m))


def plain_words(text):
    """Lower-case words of letters, marks and digits; characters of scripts without spaces alone."""
    import regex

    text = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 ", (text or "").lower())
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", text).split()


def local_alignment(item, words):
    """Best Smith-Waterman score of two word lists: 2 for equal, -1 replaced or missing in `words`, -2 for an extra one."""
    best, row = 0, [0] * (len(words) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(words):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 2))
        row, best = new, max(best, *new)
    return best


def leaks(rows, items, similarity):
    """{(doc_id, item_id): best similarity} of all pairs at the threshold."""
    out = {}
    texts = [(d, plain_words(t)) for d, t in rows if d is not None]
    for item, text in items:
        x = plain_words(text)
        for doc, words in texts:
            if x and item is not None and len(set(x) & set(words)) >= len(set(x)) * similarity - (1 - similarity) * len(x):
                same = (local_alignment(x, words) / len(x) + 1) / 3
                if same >= similarity - 1e-9:
                    out[doc, item] = max(same, out.get((doc, item), 0))
    return out
