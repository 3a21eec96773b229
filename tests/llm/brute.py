"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def spans(text):
    """(doc's counts by kind, sha of base spans)."""
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(d) <= 19 and luhn(d) if kind == "card" else True,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    out.sort()
    return {kind: sum(s[3] == kind for s in out) for kind in BASE}, ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in out)


def shingles(text, n=5):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near(rows, percent=85):
    """{doc_id: (n, component)} of rows (doc_id, text) with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    holders = {}
    for d in ids:
        seen = {}
        for s in sets[d]:
            for o in holders.setdefault(s, []):
                seen[o] = seen.get(o, 0) + 1
            holders[s].append(d)
        for o, both in seen.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[o]) - both):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    return {d: (len(sets[d]), root(d)) for d in ids}


def edited(rows):
    """{doc_id: edited text} of rows (doc_id, text) with distinct ids."""
    ids, texts = zip(*sorted((d, t or "") for d, t in rows))
    out = {}
    for i, d in enumerate(ids):
        t, nxt = texts[i], texts[(i + 1) % len(ids)]
        m = len(t) // 4
        out[d] = t[: len(t) - m] + nxt[:m]
    return out


def repeats(rows, n=50):
    """{doc_id: (bytes, removed, spans, kept)}: bytes covered by an n-byte string of a smaller doc."""
    first, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], d)
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < d:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def linked(rows):
    """For each (conv, turn, role, text): conv, turn, role, body, quotes, linked, quoted, parent and thread as conv and turn, depth."""
    low = -(2**63)
    norm = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", lower(x)))

    def cuts(passage):
        out = [(0, passage)] + [(1, p) for p in re.split(r"\n[\x20\x09-\x0D]*\n", passage)] + [(2, p) for p in passage.split("\n")]
        return [(k, norm(p)) for k, p in out if norm(p)]

    messages = []
    for conv, turn, role, text in rows:
        runs = []
        for line in re.split(r"\r?\n", text or ""):
            mark = re.match(r"(?:[ \t]*>)+[ \t]?", line)
            level = mark[0].count(">") if mark else 0
            rest = line[mark.end() :] if mark else line
            if runs and runs[-1][0] == level:
                runs[-1][1].append(rest)
            else:
                runs.append((level, [rest]))
        runs = [(level, "\n".join(x)) for level, x in runs]
        body = "\n".join(x for level, x in runs if not level).strip(" \t\n\x0b\f\r")
        own = {p for x in [body, *[x for level, x in runs if not level]] for _, p in cuts(x)}
        at = (low if conv is None else conv, low if turn is None else turn)
        messages.append((at, conv, turn, role, body, own, [r for r in runs if r[0] and norm(r[1])]))
    here, first = {}, {}
    for at, *_, own, _ in messages:
        for p in own:
            here[at[0], p] = min(here.get((at[0], p), at), at)
            first[p] = min(first.get(p, at), at)

    def origin(at, p):
        if here.get((at[0], p), at) < at:
            return here[at[0], p]
        return first[p] if first.get(p, at) < at else None

    shown = lambda at: (None, None) if at is None else tuple(None if x == low else x for x in at)
    turns, parents, out = {}, {}, []
    for at, *_ in messages:
        turns.setdefault(at[0], set()).add(at[1])
    for at, conv, turn, role, body, _, quotes in messages:
        found = []
        for n, (level, passage) in enumerate(quotes):
            options = [(k, -len(p), i, origin(at, p)) for i, (k, p) in enumerate(cuts(passage)) if origin(at, p)]
            if options:
                found.append((level, n, min(options)[3]))
        quoted = min(found)[2] if found else None
        earlier = [t for t in turns[at[0]] if t < at[1]]
        parent = quoted or ((at[0], max(earlier)) if earlier else None)
        if parent:
            parents[at] = min(parents.get(at, parent), parent)
        out.append([conv, turn, role, body, len(quotes), len(found), quoted, parent, at])
    for row in out:
        at, depth = row.pop(), 0
        while at in parents:
            at, depth = parents[at], depth + 1
        row[6:] = [*shown(row[6]), *shown(row[7]), *shown(at), depth]
    return [tuple(r) for r in out]


def mixed(rows, weights=(1, 2, 3), epochs=3, seed=7):
    """The texts that a mix of rows (doc_id, text, source) takes, with their ids, in order: whole ones by epoch, and the beginning of the one at the cut."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in order}
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    level = 0.0
    for _ in order:
        full = [s for s in order if weight[s] * level > epochs * total[s]]
        if rest := sum(weight[s] for s in order if s not in full):
            level = (sum(total.values()) - sum(epochs * total[s] for s in full)) / rest
    out = []
    for s in order:
        budget = min(epochs * total[s], round(min(epochs * total[s], weight[s] * level)))
        whole, left = divmod(budget, total[s]) if total[s] else (0, 0)
        mine = sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, t) for i, t, x in rows if x == s)
        for _, i, t in mine:
            out += [(i, t)] * (whole if size[i] else 1)
            if size[i] and 0 < left < size[i]:
                out.append((i, WORD.findall(t)[:left]))
            elif size[i] and left > 0:
                out.append((i, t))
            left -= size[i]
    return out
