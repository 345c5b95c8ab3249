"""Plain statements of what the operators return, for small inputs."""
import hashlib

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def covered(seqs, size):
    """Per id: which places lie in a window that also starts in a smaller id."""
    own = {}
    for i in sorted(seqs):
        for k in range(len(seqs[i]) - size + 1):
            own.setdefault(tuple(seqs[i][k:k + size]), i)
    return {i: [any(own[tuple(s[j:j + size])] < i for j in range(max(0, k - size + 1), min(k, len(s) - size) + 1)) for k in range(len(s))]
            for i, s in seqs.items()}


def substring(rows, size=50):
    seqs = {i: (t or "").encode().split() for i, t in rows}
    out = {}
    for i, gone in covered(seqs, size).items():
        kept = b" ".join(w for w, g in zip(seqs[i], gone) if not g)
        out[i] = (len(gone), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def suffix(rows, size=50):
    seqs = {i: (t or "").encode() for i, t in rows}
    out = {}
    for i, gone in covered(seqs, size).items():
        kept = bytes(c for c, g in zip(seqs[i], gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(gone), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = (text or "").encode().translate(_LOWER).split()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
              if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def lines(rows, size=2):
    """Per id: lines left, and how many went; earlier means a smaller id or further up."""
    full = {i: [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")] for i, t in rows}
    seen, out = set(), {}
    for i, t in sorted(rows):
        seq, cut = full[i], set()
        for k in range(len(seq) - size + 1):
            g = tuple(x for _, x in seq[k:k + size])
            if g in seen:
                cut |= {n for n, _ in seq[k:k + size]}
            seen.add(g)
        out[i] = ("\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in cut), len(cut))
    return out
