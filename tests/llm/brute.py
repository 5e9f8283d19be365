"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
import statistics

WS = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(rows):
    """{doc_id: (keep_id, size, sha)} for unique ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(WS.sub(" ", t or ""), []).append(i)
    return {i: (min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + 5))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def verdicts(rows, limit=0.5):
    """Per row (text, host): whether the rules and its host's shrunk rates let it pass."""
    hosts, found = {}, []
    for text, host in rows:
        n, _, symbols, dup, covered, base = rules(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        found.append((n, symbols, base, host))
        hosts.setdefault(host, []).append((n < 10, 100 * covered > 20 * n, 10 * symbols > n, 10 * dup > 3 * lines))
    ok, scale = dict.fromkeys(hosts, True), {}
    for k in range(4):
        fails = {h: sum(v[k] for v in x) for h, x in hosts.items()}
        mean = (sum(fails.values()) + 0.5) / (len(rows) + 1)
        rates = [fails[h] / len(x) for h, x in hosts.items()]
        spread = statistics.variance(rates) if len(rates) > 1 else 0
        w = 1000.0 if spread <= 0 else min(1000.0, max(1.0, mean * (1 - mean) / spread - 1))
        for h, x in hosts.items():
            rate = (fails[h] + mean * w) / (len(x) + w)
            ok[h] &= rate <= limit
            if k == 2:
                scale[h] = max(0.5, min(2.0, rate / mean))
    return [not base and ok[h] and not 10 * s * scale[h] > n for n, s, base, h in found]


def shingles(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(t)
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near(rows, percent=85):
    """{doc_id: (size, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    done = set()
    for ids in index.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(rows, width=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} for exact substring dedup."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for at in range(len(b) - width + 1):
            w = b[at:at + width]
            if w in seen:
                cover[at:at + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = len(re.findall(b"\1+", bytes(cover)))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out
