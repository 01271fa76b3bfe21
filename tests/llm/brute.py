"""Plain Python versions of the jobs, to hold results against."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def ids_crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def token_rows(docs, tokenizer):
    """docs: (doc_id, text) in order; rows doc_id -> (start, n_tokens, crc)."""
    out, start = {}, 0
    for i, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out[i] = (start, len(ids), ids_crc(ids))
        start += len(ids)
    return out


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:end]


def url_rule(host, path, rules):
    best = None
    for rule, verdict in rules.items():
        h, p = rule[:rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(rule), len(h)) > (len(best[0]), best[0].index("/"))):
            best = rule, verdict
    return best or (None, None)


def repeats(docs, length=13):
    """doc_id -> (n_words, n_removed, sha of the kept words); ids are distinct."""
    first, all_words = {}, {i: words(t) for i, t in docs}
    for i, w in all_words.items():
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in all_words.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k:k + length])] < i:
                gone.update(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_groups(docs, percent=75):
    """doc_id -> (set size, component); compares all sets that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    at = {}
    for i in sorted(sets):
        near = Counter(j for s in sets[i] for j in at.get(s, ()))
        for j, common in near.items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for s in sets[i]:
            at.setdefault(s, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def rule_counts(text):
    text = text or ""
    w = words(text)
    n = len(w)
    chars = sum(len(x.decode()) for x in w)
    lines = [x for x in text.split("\n") if WORD.search(x.encode())]
    windows = Counter(tuple(w[k:k + 3]) for k in range(n - 2))
    hit = set()
    for k in range(n - 2):
        if windows[tuple(w[k:k + 3])] > 1:
            hit.update((k, k + 1, k + 2))
    return (n, chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


BASE = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def secret_rows(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    said = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found))
    return tuple(sum(k == j for _, k, _ in found) for j in range(3)) + (hashlib.sha256(said.encode()).hexdigest(),)


AROUND = ".,;:!?\"'()[]{}«»„“”‘’…"


def common_words(items, number, numbers):
    """Words that stand in lower case in the benchmark and are no numbers."""
    bare = [w.decode().strip(AROUND) for _, t in items for w in words(t)]
    return {b for b in bare if b == b.lower() and not number.match(b) and b not in numbers}


def template(text, number, numbers, units, common):
    """(kind, value) of each template word; kind 0 is a literal, 1 a number, 2 a unit, 3 a run of names."""
    out, joins = [], False
    for w in words(text):
        t = w.decode()
        left = t.lstrip(AROUND)
        bare = left.rstrip(AROUND)
        low = bare.lower()
        name = bare[:1].isupper() and not (len(bare) > 1 and bare.isupper()) and low not in common
        kind = 1 if number.match(bare) or low in numbers else 2 if low in units else 3 if name else 0
        if kind == 3 and joins and left == t:
            out[-1] = (3, f"{out[-1][1]} {low}")
        else:
            out.append((kind, low))
        joins = kind == 3 and bare == left
    return out


def leaks(docs, items, module):
    """Pairs (doc_id, item_id) with an exact window or an occurrence whose slots are consistent; ids are distinct."""
    common = common_words(items, module._NUMBER, module.NUMBERS)
    read = {t: template(t, module._NUMBER, module.NUMBERS, module.UNITS, common) for _, t in [*docs, *items]}
    short = {len(read[t]) for _, t in items} - {0}

    def windows(text, of_item):
        t = read[text]
        for size in {module.WINDOW, *(n for n in short if n < module.WINDOW)}:
            whole = size < module.SHORT or of_item and size < module.WINDOW
            for k in range(len(t) - size + 1):
                part = t[k:k + size]
                if whole and len(t) != size:
                    continue
                if sum(not kind for kind, _ in part) >= (module.LITERAL if size == module.WINDOW else module.SHORT_LITERAL):
                    yield tuple(kind or v for kind, v in part), k, [x for x in part if x[0]]
                    if of_item:
                        continue
                yield ("as is", *(v for _, v in part)), k, []

    at, out = {}, set()
    for item, text in items:
        for shape, k, slots in windows(text, True):
            at.setdefault(shape, []).append((item, k, slots))
    for doc, text in docs:
        met = {}
        for shape, k, slots in windows(text, False):
            for item, j, theirs in at.get(shape, ()):
                if slots == theirs:
                    out.add((doc, item))
                for x, y in zip([(None, None)] + slots, [(None, None)] + theirs):
                    met.setdefault((item, k - j), {}).setdefault(y, set()).add(x)
        out |= {(doc, item) for (item, _), values in met.items() if all(len(v) == 1 for v in values.values())}
    return out


def redacted(text, rules, mark="[SECRET]"):
    hidden = sorted(m.span() for r in rules for m in r.exact.finditer(text) if len(m["tail"]) >= r.least)
    out, at = "", 0
    for a, b in hidden:
        out += (text[at:a] + mark) if a >= at else ""
        at = max(at, b)
    return out + text[at:]


def runs(w, least=12):
    """(start, length, period) of all runs, lag by lag."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def run_row(doc_id, text):
    """A row of the run job, after the contract's change of every tenth text."""
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes, fanout=8):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def proofs(rows):
    """rows: (group, key, leaf, altered); gives (key, leaf, subroot, root, digest of siblings, folded root) of each."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    trees = {g: levels([r[2] for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, key, own, altered) in enumerate(groups[g]):
            siblings = []
            for tree, at in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    low = at // 8 * 8
                    run = level[low:low + 8]
                    before, after = run[:at - low], run[at - low + 1:]
                    siblings += before + after
                    altered, at = digest(*before, altered, *after), at // 8
            out.append((key, own, trees[g][-1][0], top[-1][0], digest(*siblings), altered))
    return out
