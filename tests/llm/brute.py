"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def least(nodes, links):
    top = {x: x for x in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def jaccard(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * den < num * max(len(x), len(y)):
                continue
            if den * (same := len(x & y)) >= num * (len(x) + len(y) - same):
                links.append((a, b))
    top = least(list(sets), links)
    return {(i, len(sets[i]), top[i]) for i in sets}


def repeats(rows, k=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + k] for _, t in texts for p in range(len(t) - k + 1))
    out = set()
    for i, t in texts:
        hit = bytearray(len(t))
        for p in range(len(t) - k + 1):
            if seen[t[p : p + k]] > 1:
                hit[p : p + k] = b"\x01" * k
        runs = len(re.findall(rb"\x01+", bytes(hit)))
        out.add((i, len(t), sum(hit), runs, hashlib.sha256(bytes(c for c, h in zip(t, hit) if not h)).hexdigest()))
    return out


def near_lines(rows, least_words=8):
    """Rows (id, line number) that go: an earlier line is equal, or at most one word apart if both have enough words."""
    lines = []
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", line.translate(UP)))
            if words:
                lines.append(((i, k), words))
    gone = set()
    for x, (at, a) in enumerate(lines):
        for _, b in lines[:x]:
            if a == b or (min(len(a), len(b)) >= least_words and one_apart(a, b)):
                gone.add(at)
                break
    return gone


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def windows(docs, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))

    found = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            found[tuple(w[k : k + n])].add(i)
    sizes = {len(k) for k in found}
    out = set()
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if (x := found.get(tuple(w[k : k + s]))) is not None:
                    hit.update(range(k, k + s))
                    ids |= x
        out.add((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    text = text or ""
    spans = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            spans.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    spans.sort()
    n = Counter(x[2] for x in spans)
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def crc(data):
    return zlib.crc32(data)
