"""Brute-force versions and small tables for the tests of the operators."""

import hashlib
import math

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
BLANK = " \t\n\x0b\x0c\r"


def docs_frame(spark, rows, parts=3, extra=True):
    """Documents from ``(doc_id, text[, lang, source])``, with columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s",
             None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS).repartition(parts)
    if extra:
        df = df.selectExpr("*", "1.5D as score", "'x' as kind", "2 as position", "3 as component_id", "4 as gone",
                           "5 as size", "6 as id", "7 as length")
    return df


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(nodes, pairs):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    return {n: find(parent, n) for n in nodes}


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    words = []
    word = ""
    for c in ascii_lower(text or "") + " ":
        if c in BLANK:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def jaccard_components(rows):
    """``[(doc_id, n, component)]`` of rows ``(doc_id, text)`` with distinct ids, by all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    pairs = []
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) * 100 >= 80 * len(x | y):
                pairs.append((a, b))
    comp = components(ids, pairs)
    return sorted((d, len(sets[d]), comp[d]) for d in ids)


def line_key(line):
    return ascii_lower(line.strip(BLANK))


def deduped_lines(rows):
    """``{doc_id: (lines, dropped, kept text)}`` of rows with distinct ids."""
    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line_key(line)
            if len(k) >= 10:
                owner[k] = min(owner.get(k, d), d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(line_key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cosine(a, b):
    dot = na = nb = 0.0
    for x, y in zip(a, b):
        dot += x * y
        na += x * x
        nb += y * y
    return dot / (math.sqrt(na) * math.sqrt(nb))


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x for x in v)
