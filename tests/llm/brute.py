"""Plain restatements of the contracts, for small inputs."""

import collections
import hashlib
import math
import re
import string
import zlib

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lines(docs):
    key = lambda x: x.strip(BLANK).translate(LOW)
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = {}
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if last.get(key(x), i) == i]
        out[i] = (len(parts), len(parts) - len(kept), sha("\n".join(kept)))
    return out


def repeats(docs):
    first, out = {}, {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    for i, t in docs:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                covered[p : p + 50] = b"\1" * 50
        out[i] = (len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), sha(bytes(c for c, g in zip(b, covered, strict=True) if not g)))
    return out


def contaminated(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[k]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def shingles(t):
    w = [x for x in re.split(f"[{BLANK}]+", (t or "").translate(LOW)) if x]
    return {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()


def near(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    c = components(ids, links)
    return {i: (len(sets[i]), c[i], c[i] == i) for i in ids}


def trie(rows, every=20, most=4):
    """Nodes of the rebuilt conversations of (conv_id, turn, role, text)."""
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = tuple(own.get(int(math.fmod(c, -every)) * -1 + c, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    saved, leaves = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends)))
    return sorted(out, key=repr)
