"""Slow, plain versions of the operators, which the tests compare with."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def near_duplicates(rows, width, percent):
    """rows: (id, text). {id: (n, component)}; ids must be distinct."""
    sets = {}
    for i, t in rows:
        w = space_words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by, seen = {}, set()
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeated_words(rows, width):
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = space_words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in rows:
        w = space_words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contamination(text, items, width=10):
    """(n_words, n_hit, item ids) of one text; items: (id, text)."""
    words, hit, found = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            window = w[i : i + width]
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def phrases(text, known):
    """(start, label) of each place where a phrase's words stand."""
    words = plain_words(text)
    return sorted((k, label) for phrase, label in known.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())


def base_spans(text):
    """kind:start:end of the four base patterns, by their plain definition."""
    text = text or ""

    def luhn(digits):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [":".join(map(str, x)) for x in out]


def boxes(data):
    """Nested boxes of an ISO file as (path, body), by recursion over slices."""
    nested, out = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"}, []

    def walk(part, path):
        while part:
            n, kind = int.from_bytes(part[:4], "big"), part[4:8]
            body = part[8:n]
            out.append((path + [kind], body))
            if kind in nested:
                walk(body, path + [kind])
            part = part[n:]

    walk(data, [])
    return out
