"""Plain versions of the training-text operators, over Python lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crc(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base_scores(docs):
    """(n_tokens, n_known, N, base_score) of each row."""
    tokens = [[*words(t), None] for _, t in docs]
    counts = Counter(x for (d, _), ts in zip(docs, tokens, strict=True) if crc(d) % 7 != 2 for x in ts)
    n, v = sum(counts.values()), len(counts)
    return [(len(ts), sum(counts[x] > 0 for x in ts), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts)) for ts in tokens]


def without_repeats(docs, window):
    """(n_words, n_removed, kept) of each row."""
    every = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(docs, items, window):
    """(n_words, n_hit, n_items, hash of items, contaminated) of each row."""
    windows = defaultdict(set)
    for item, text in items:
        w = PLAIN.findall((text or "").translate(LOWER))
        if item is not None and w:
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                windows[tuple(w[i : i + size])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for _, text in docs:
        w = PLAIN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if items_here := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= items_here
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_duplicates(docs, size=3, percent=85):
    """(n_shingles, component_id) of each row; rows of one doc_id are one node."""
    sets = [shingles(t, size) for _, t in docs]
    parent = {d: d for d, _ in docs if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            b, shared = docs[j][0], len(sets[i] & sets[j])
            if a is not None and b is not None and shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [(len(s), None if d is None else root(d) if s else d) for (d, _), s in zip(docs, sets, strict=True)]


def line_dedup(docs):
    """(n_lines, n_dropped, kept) of each row."""
    keyed = [[(line, line.strip(" \t\n\r\x0b\x0c").translate(LOWER)) for line in (t or "").split("\n")] for _, t in docs]
    holders = defaultdict(list)
    for (d, _), lines in zip(docs, keyed, strict=True):
        for key in {k for _, k in lines if len(k) >= 20}:
            holders[key].append(-math.inf if d is None else d)
    out = []
    for (d, _), lines in zip(docs, keyed, strict=True):
        own = -math.inf if d is None else d
        kept = [line for line, k in lines if len(holders.get(k, ())) < 3 or own == max(holders[k])]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def earliest_deadlines(shares):
    """Source numbers by slot for one round of blocks."""
    total, done, out = sum(shares), [0] * len(shares), []
    for slot in range(total):
        due = [(-(-(done[k] + 1) * total // q), k) for k, q in enumerate(shares) if done[k] < q and done[k] * total // q <= slot]
        out.append(min(due)[1])
        done[out[-1]] += 1
    return out


def folded(words, doc_id):
    """Words after the change that the id's crc32 asks for."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs(words, least=6, repeats=4):
    """(start, length, period) of each maximal stretch with its smallest period."""
    n, out = len(words), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q) and not any(all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def run_digests(text, doc_id):
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    words = folded(WORD.findall(text or ""), doc_id)
    found = runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_secrets(text):
    """(n_assign, n_access, n_hex, sha256 of all) of the base spans."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def rebuilt_conversations(rows):
    """Turns (role, text) of each rebuilt conversation, by conv_id; rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), mark, (role, text)))
    own = {c: [t for _, _, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def trie(rows):
    """The node rows of the prefix trie."""
    whole = rebuilt_conversations(rows)
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(p))
        out.append((convs[0], len(p), members[p[:-1]][0] if p else None, len(convs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)
