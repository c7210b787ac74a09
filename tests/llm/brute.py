"""Plain versions of the operators, for small inputs."""


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text, size):
    w = words(text, True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def near_duplicates(rows, size, percent):
    """{doc_id: (n_shingles, component_id)} by testing all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def removed_words(rows, size=35):
    """{row number: set of covered word positions}."""
    seen = {}
    for k, (_, text) in enumerate(rows):
        w = words(text)
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append((k, i))
    out = {k: set() for k in range(len(rows))}
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                out[k].update(range(i, i + size))
    return out


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    tri = {}
    for i in range(len(w) - 2):
        tri.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {j for at in tri.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    return (
        len(w),
        sum(len(x.decode()) for x in w),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(hit),
    )


def contaminated(text, items, size=5, percent=80):
    """Ids of the items that some window of ``text`` is alike."""
    from collections import Counter

    def grams(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    w, out = (text or "").lower().encode().split(), set()
    for item, t in items:
        v = (t or "").lower().encode().split()
        if not v:
            continue
        k, n = min(size, len(v)), min(len(v), len(w))
        b = grams(v, k)
        for s in range(len(w) - n + 1):
            a = grams(w[s : s + n], k)
            both = sum((a & b).values())
            if both and 100 * both >= percent * (sum(a.values()) + sum(b.values()) - both):
                out.add(item)
                break
    return out
