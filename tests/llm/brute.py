"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re

LOW = bytes((b + 32 if 65 <= b <= 90 else b) for b in range(256))


def alnum(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))


def spaced(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOW))


def substrings(docs, size=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if b[s : s + size] in seen:
                mark[s : s + size] = b"\1" * size
            else:
                seen.add(b[s : s + size])
        runs = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[i] = (len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest())
    return out


def groups(docs, size, percent=80):
    def shingles(t):
        w = spaced(t)
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def contamination(docs, items, width=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        n = min(len(w), width)
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                x = windows.get(tuple(w[k : k + n]))
                if x:
                    found |= x
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def bm25(docs, queries, k=10):
    tf = {i: collections.Counter(alnum(t)) for i, t in docs}
    size = {i: sum(c.values()) for i, c in tf.items()}
    n, average = len(docs), sum(size.values()) / len(docs)
    df = collections.Counter(w for c in tf.values() for w in c)
    out = set()
    for q, t in queries:
        asked, found = collections.Counter(alnum(t)), []
        for i, c in tf.items():
            s = sum(f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / average)) for w, f in asked.items() if w in c)
            if s > 0:
                found.append((-round(s, 6), i))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


def bm25_rows(docs, queries, k):
    """As bm25, where rows of docs may repeat: sorted rows."""
    counts = [(i, collections.Counter(alnum(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, average = len(docs), sum(sizes) / len(docs)
    df = collections.Counter(w for _, c in counts for w in c)
    out = []
    for q, t in queries:
        found = []
        for (i, c), size in zip(counts, sizes, strict=True):
            s = sum(f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / average)) for w, f in collections.Counter(alnum(t)).items() if w in c)
            if s > 0:
                found.append((-round(s, 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)
