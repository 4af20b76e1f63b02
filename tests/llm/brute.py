"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def classes(ids, linked):
    """Smallest reachable id of each id, by the given links."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_classes(docs, k, share):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    found = classes(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def repeats(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[k:k + length] for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if count[d[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(d)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def edits_within(pattern, text):
    """Fewest edits between ``pattern`` and any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def base_scores(rows, parts):
    count, tokens = Counter(), []
    for i, t in rows:
        tokens.append(words(t) + ["</end>"])
        if i is None or zlib.crc32(str(i).encode()) % parts != 2:
            count.update(tokens[-1])
    total, distinct = sum(count.values()), len(count)
    return [(i, len(t), sum(count[w] > 0 for w in t), total,
             sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t)) for (i, _), t in zip(rows, tokens)]


def spelling_variants(docs):
    """(word, form, root, n, n_near, form_n) by comparing words with one code point left out."""
    import re
    import zlib
    from collections import Counter, defaultdict

    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    alike, near = defaultdict(set), defaultdict(set)
    for w in n:
        for j in range(len(w)):
            alike[w[:j], w[j + 1:]].add(w)
    for w in n:
        for j in range(len(w)):
            near[w] |= alike[w[:j], w[j + 1:]] - {w}
            if w[:j] + w[j + 1:] in n:
                near[w].add(w[:j] + w[j + 1:])
                near[w[:j] + w[j + 1:]].add(w)
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def clusters(rows, k=8, rounds=10, seed=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) in Python integers."""
    import hashlib
    import math
    from fractions import Fraction

    kept = [(i, v) for i, v in rows if v and len(v) == 64 and None not in v and all(map(math.isfinite, v))]
    points = [[math.floor(Fraction(x) * 1024) for x in v] for _, v in kept]
    key = lambda j: (kept[j][0] is None, hashlib.sha256(f"{seed}:{kept[j][0]}".encode()).hexdigest(), kept[j][1])
    centres = [points[j] for j in sorted(range(len(kept)), key=key)[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for p in points:
            groups.setdefault(nearest(p)[1], []).append(p)
        for j, group in groups.items():
            centres[j] = [sum(column) // len(group) for column in zip(*group)]
    found = [nearest(p) for p in points]
    inertia = {}
    for d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    fit = lambda v: v if v < 1 << 63 else None
    wide = {j for d, j in found if fit(d) is None}
    return [(i, j, fit(d), None if j in wide else fit(inertia[j]), None if wide else fit(sum(inertia.values())),
             hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found)]
