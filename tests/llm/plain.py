"""Plain single-process versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

FOLD = {c: c + 32 for c in range(65, 91)}
SPACE = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACE, text or "")


def jaccard(rows):
    """rows: (doc_id, text) -> per row (n_shingles, component_id, n_links)."""
    sets = []
    for _, text in rows:
        w = words((text or "").translate(FOLD))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return [(len(sets[i]), smallest[find(i)] if sets[i] else rows[i][0], links[i]) for i in range(len(rows))]


def repeats(texts, length):
    """Per text (n_bytes, spans, kept_sha256)."""
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for b in raw:
        spans = []
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, at = b"", 0
        for a, e in spans:
            kept, at = kept + b[at:a], e
        out.append((len(b), spans, hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


def lines(rows, min_chars=20, min_documents=3):
    """Per row (n_lines, n_dropped, kept text)."""
    order = lambda d: (d is not None, d)
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(list)
    for n, (d, text) in enumerate(rows):
        for key in {x.strip(strip).translate(FOLD) for x in (text or "").split("\n")}:
            if len(key) >= min_chars:
                holders[key].append((n, d))
    out = []
    for d, text in rows:
        all_lines = (text or "").split("\n")
        stay = []
        for x in all_lines:
            own = holders.get(x.strip(strip).translate(FOLD), [])
            if len(own) >= min_documents and d != max((h for _, h in own), key=order):
                continue
            stay.append(x)
        out.append((len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return out


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(SPACE, x):
            dup += x in seen
            seen.add(x)
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    covered = {p + k for places in grams.values() if len(places) > 1 for p in places for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)
