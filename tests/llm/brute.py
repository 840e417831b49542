"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def window_dedup(docs: list[tuple], width: int) -> list[tuple]:
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    least: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return sorted(out)


def suffix_dedup(docs: list[tuple], depth: int) -> list[tuple]:
    texts = [(d, (t or "").encode()) for d, t in docs]
    least: dict[bytes, tuple] = {}
    for d, b in texts:
        for i in range(len(b) - depth + 1):
            k = b[i : i + depth]
            if k not in least or (d, i) < least[k]:
                least[k] = (d, i)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if least[b[i : i + depth]] < (d, i):
                gone[i : i + depth] = b"\x01" * depth
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out)


def shingle_sets(docs: list[tuple], k: int = 5) -> dict:
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(AZ))
        out[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def components(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_join(docs: list[tuple]) -> list[tuple]:
    sets = shingle_sets(docs)
    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    shared: dict = {}
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return sorted((d, len(s), comp[d]) for d, s in sets.items())


def language_model(seqs: list[list], mass: tuple = (300.0, 0.3)):
    """p(words before, word) of the trigram model of token sequences (None: the end; 0: the begin)."""
    from collections import Counter

    uni, bi, tri = Counter(), Counter(), Counter()
    for w in seqs:
        h = [0, *w]
        uni.update(w)
        bi.update(zip(h, h[1:]))
        tri.update(zip(h, h[1:], h[2:]))
    n, v = sum(uni.values()), len(uni)
    uses = lambda h: len(seqs) if h == 0 else uni[h]

    def p(before: list, x):
        out = (uni[x] + 0.1) / (n + 0.1 * (v + 1))
        out = (bi[before[-1], x] + mass[0] * out) / (uses(before[-1]) + mass[0])
        if len(before) > 1:
            a, b = before[-2:]
            out = (tri[a, b, x] + mass[1] * out) / (bi[a, b] + mass[1])
        return out

    return p, uni, n, v


def lm_score(docs: list[tuple]) -> list[tuple]:
    import math
    import zlib

    seqs = [(d, zlib.crc32(str(d).encode()) % 10 == 0, [*WORD.findall((t or "").translate(AZ)), None]) for d, t in docs]
    p, uni, n, v = language_model([w for _, held, w in seqs if not held])
    out = []
    for d, held, w in seqs:
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(p([0, *w[:i]], x)) for i, x in enumerate(w))
        out.append((d, held, len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return sorted(out)


def merkle(rows: list[tuple], tampered, tampering) -> list[tuple]:
    """rows: (doc_id, source, lang, n_chars, text).  One tuple a row: doc_id, leaf, subroot, root, proof, folded root, verified."""
    h = lambda s: sha(s.encode())
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def beside(levels, i):
        out = []
        for level in levels[:-1]:
            a = i // 3 * 3
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
            i //= 3
        return out

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            proof = beside(trees[s], i) + beside(top, k)
            cur = leaf((*r[:4], tampering(r[4]))) if r[4] is not None and tampered(r) else leaf(r)
            for left, right in proof:
                cur = h(left + cur + right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h("".join(x + y for x, y in proof)), cur, cur == top[-1][0]))
    return out


def hard_negatives(rows: list[tuple], is_anchor, scale=256, positives=5, negatives=10, low=30, high=90) -> list[tuple]:
    """rows: (vec_id, vector, label).  (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    import math

    fit = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = lambda i: -(2**63) if i is None else i
    out = []
    for a, (ai, av, ay) in enumerate(fit):
        if ai is None or not is_anchor(ai):
            continue
        scored = []
        for b, (bi, bv, by) in enumerate(fit):
            if a != b and len(av) == len(bv):
                score = sum(p * q for p, q in zip(av, bv, strict=True))
                scored.append((-max(-(2**63) + 1, min(2**63 - 1, score)), least(bi), bi, by))
        scored.sort(key=lambda s: s[:2])
        for ps, _, pi, _ in [s for s in scored if s[3] == ay][:positives]:
            fitting = [s for s in scored if s[3] != ay and -low * ps <= -100 * s[0] <= -high * ps][:negatives]
            out += [(ai, pi, k + 1, ni, -ps, -ns) for k, (ns, _, ni, _) in enumerate(fitting)]
    return out
