"""Small plain-Python models that the operators are held against."""


def suffixes(seqs):
    """(seq, pos) of every suffix in order; ends come first and in sequence order."""
    return sorted(((s, p) for s, t in enumerate(seqs) for p in range(len(t) + 1)), key=lambda x: (seqs[x[0]][x[1] :], x[0]))


def bwt(seqs):
    return "".join(seqs[s][p - 1] if p else "$" for s, p in suffixes(seqs))


def occurrences(seqs, w):
    return [(s, p) for s, t in enumerate(seqs) for p in range(len(t) - len(w) + 1) if t.startswith(w, p)] if w else []


def mems(seqs, read, least, m):
    m = max(m, 1)
    n = len(read)
    ok = lambda a, b: 0 <= a < b <= n and len(occurrences(seqs, read[a:b])) >= m
    order = {x: k for k, x in enumerate(suffixes(seqs))}
    out = []
    for a in range(n):
        for b in range(a + least, n + 1):
            if ok(a, b) and not ok(a - 1, b) and not ok(a, b + 1):
                at = [order[x] for x in occurrences(seqs, read[a:b])]
                out.append((a, b, min(at), len(at)))
    return out
