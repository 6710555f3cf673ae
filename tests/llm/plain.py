"""Brute-force versions of the operators, in plain Python over lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def similar_groups(rows, k, percent):
    """doc_id -> (set size, least reachable id), by all pairs."""
    sets = {}
    for i, text in rows:
        words = SPACED.findall((text or "").translate(FOLD))
        sets[i] = {tuple(words[p : p + k]) for p in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            inner = len(sets[x] & sets[y])
            if x < y and inner and 100 * inner >= percent * (len(sets[x]) + len(sets[y]) - inner):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def kept_passages(rows, window):
    """doc_id -> (words, removed, kept text)."""
    words = {i: SPACED.findall(text or "") for i, text in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    result = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        result[i] = (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    return result


def contamination(rows, items, window):
    """doc_id -> (words, hit words, item ids sorted as strings)."""
    windows = {}
    for i, text in items:
        w = PLAIN.findall((text or "").translate(FOLD))
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[p : p + m]), set()).add(str(i))
    result = {}
    for i, text in rows:
        w = PLAIN.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if own := windows.get(tuple(w[p : p + size])):
                    hit.update(range(p, p + size))
                    found |= own
        result[i] = (len(w), len(hit), sorted(found))
    return result


def base_spans(text):
    """(start, kind rank, end, kind) of the base kinds."""
    named = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    assign = named + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def chained(values, seed=42):
    """Hash of strings or longs, each seeded with the one before, as a signed 64-bit number."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def syncmers(units, k, s, level):
    """(place, anchor) of the K-mers whose least inner hash stands at an edge."""
    found = []
    hashes = [chained([u]) for u in units]
    for p in range(len(units) - k + 1):
        inner = [chained(hashes[p + j : p + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            cover = sorted({*range(0, k - s + 1, s), k - s})
            found.append((p, (chained([inner[j] for j in cover]) % 2**64 >> 33) * 2 + level))
    return found


def fingerprint(text):
    spaceless = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
                 (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
    units, run = [], ""
    for c in text.lower():
        single = any(a <= ord(c) <= b for a, b in spaceless)
        if run and (single or c in " \t\n\v\f\r" or len(run) == 16):
            units.append(run)
            run = ""
        if single:
            units.append(c)
        elif c not in " \t\n\v\f\r":
            run += c
    units += [run] if run else []
    found = syncmers(units, 8, 2, 0)
    if len(units) < 48:
        whole = " ".join(units)
        if len(whole) >= 6:
            found += syncmers(list(whole), 6, 3, 1)
        elif whole:
            found.append((0, (chained([whole]) % 2**64 >> 33) * 2 + 1))
    return found


def likeness(a, b):
    if not a and not b:
        return 1.0
    level = int(all(any(h & 1 for _, h in x) for x in (a, b)))
    first = []
    for x in (a, b):
        own = {}
        for p, h in x:
            if h & 1 == level:
                own.setdefault(h, p)
        first.append(own)
    x, y = first
    if not x and not y:
        return 0.0
    band = max(4, max([*x.values(), *y.values()]) // 16)
    bands = Counter((y[h] - x[h]) // band for h in x.keys() & y.keys())
    return max((n + bands[g - 1] for g, n in bands.items()), default=0) / len(x.keys() | y.keys())


def byte_letters():
    """Byte of each character that stands for one in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + n): b for n, b in enumerate(hidden)}}


def alignments(rows, a_path, b_path):
    """doc_id -> (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), by looking at every pair of tokens nearby."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model, letters = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), byte_letters()
    a_model.encode_special_tokens = True
    links, base, counts = {}, {}, {}
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        a_ids = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b_model.encode(text) if text else []
        a = [bytes(letters[c] for c in a_model.id_to_token(x)) for x in a_ids]
        names = [b_model.id_to_piece(x) for x in b_ids]
        b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b_ids, names)]
        if not text or b"".join(a) != raw or b"".join(b) != raw:
            a_ids, b_ids, a, b = [], [], [], []
        spans = []
        for parts in (a, b):
            place, own = 0, []
            for part in parts:
                own.append((place, place + len(part)))
                place += len(part)
            spans.append(own)
        found, j = [], 0
        for x, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            found += [(a_ids[x], b_ids[y]) for y in range(j, len(b)) if spans[1][y][0] < e]
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        names, start = [], 0
        for end in both:
            names.append("|".join(",".join(str(n) for n, (s, e) in zip(ids, own) if start <= s and e <= end)
                                  for ids, own in zip((a_ids, b_ids), spans)))
            start = end
        links[i], base[i] = found, (len(a_ids), len(b_ids), len(both), ";".join(names))
        for pair in set(found):
            counts[pair] = counts.get(pair, 0) + 1
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return {i: (*base[i][:3], len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), base[i][3])
            for i, own in links.items()}
