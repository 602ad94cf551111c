"""Plain versions of the operators' results, for small tables."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def near_duplicates(rows):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    where = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            where[s].append(i)
    pairs = collections.Counter()
    for members in where.values():
        for k, a in enumerate(members):
            for b in members[k + 1:]:
                pairs[a, b] += 1
    for (a, b), both in pairs.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeats(texts, length):
    """(n_removed, n_spans, kept digest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k:k + 8])].append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def personal_data(text):
    """(kind, start, end) of the base patterns, kinds in order."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def folded(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", ascii_lower(text or "")).strip().encode()


def edit_place(pattern, text):
    """Fewest edits of the pattern against any place in the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def aligned(text, a, b):
    """A ids, B ids, groups and links of a text; ``a`` and ``b`` have (encode, bytes_of)."""
    raw, ids = (" " + (text or "")).encode(), []
    for encode, bytes_of in (a, b):
        own = list(encode([text or ""])[0])
        if not text or b"".join(bytes_of[i] for i in own) != raw:
            return [], [], [], []
        end, ends = 0, []
        for i in own:
            ends.append((end, end := end + len(bytes_of[i]), i))
        ids.append(ends)
    groups, first = [], 0
    for cut in sorted({e for _, e, _ in ids[0]} & {e for _, e, _ in ids[1]}):
        groups.append("|".join(",".join(str(i) for s, e, i in own if first <= s and e <= cut) for own in ids))
        first = cut
    links = [(i, j) for s, e, i in ids[0] for t, f, j in ids[1] if s < f and t < e]
    return [i for *_, i in ids[0]], [j for *_, j in ids[1]], groups, links
