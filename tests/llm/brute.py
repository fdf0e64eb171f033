"""Plain-Python forms of what the operators compute."""

import hashlib
import re

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, pattern=SPACE_WORD):
    return pattern.findall((text or "").encode().translate(LOWER))


def removed_bytes(texts, length=100):
    """(n_bytes, n_removed, n_spans, sha256) of texts in document order."""
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            part = b[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(part)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def leaks(text, items, window=10):
    """(n_words, hit positions, item ids) of one text."""
    w = words(text, ALNUM_WORD)
    hit, found = set(), set()
    for item, item_text in items:
        x = words(item_text, ALNUM_WORD)
        windows = [x] if 0 < len(x) < window else [x[i : i + window] for i in range(len(x) - window + 1)]
        for p in windows:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item) if item is not None else "")
    return len(w), sorted(hit), sorted(found)


def shingles(text, n=4):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(sets, percent=85):
    """Index of each set's smallest linked set."""
    head = list(range(len(sets)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    head[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(x for i in at for x in (i, i + 1, i + 2))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def units(text, min_words=5):
    """(start byte, words) of a text's sentences."""
    b = (text or "").encode().translate(LOWER)
    out, now = [], []
    found = list(SPACE_WORD.finditer(b))
    for k, m in enumerate(found):
        now.append(m)
        last = k + 1 == len(found)
        if last or m.group()[-1:] in b".!?" or b"\n" in b[m.end() : found[k + 1].start()]:
            out.append((now[0].start(), tuple(x.group() for x in now)))
            now = []
    return out
