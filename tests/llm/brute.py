"""Plain versions of the text operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(hashes: list[int]) -> int:
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def text_print(text: str | None, shingle: int = 3) -> int:
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    return simhash([xxhash.xxh64_intdigest(p.encode(), 42) for p in parts])


def groups(nodes: list, links) -> dict:
    """The smallest node reachable from each."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def near(prints: list[int], distance: int = 3):
    distinct = sorted(set(prints))
    return [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= distance]


def measures(text: str | None) -> dict:
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def base_failed(m: dict) -> bool:
    return m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]


def kept(text: str | None) -> bool:
    import regex

    m = measures(text)
    if base_failed(m):
        return False
    found = lambda pattern: len(regex.findall(pattern, text))
    return not (
        m["n_symbols"] * 10 > m["n_words"]
        or m["n_dup_lines"] * 10 > m["n_lines"] * 3
        or m["word_chars"] < m["n_words"] * 2
        or m["word_chars"] > m["n_words"] * 12
        or found(r"\p{Lu}") * 2 > m["word_chars"]
        or found("!") * 10 > m["n_words"] * 3
        or found(r"(?m)(\.\.\.|…)[\x20\t\r]*$") * 10 > m["n_lines"] * 3
        or found(r"(?m)^[\x20\t]*[-*•][\x20\t]") * 10 > m["n_lines"] * 9
        or found(r"\p{L}") * 10 < m["word_chars"] * 6
    )


def edit_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normalise(line: str) -> tuple[str, ...]:
    import regex

    return tuple(regex.findall(r"[\p{L}\p{N}]+", line.lower()))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def edit_distances(some: list[str], b: str, most: int) -> np.ndarray:
    """The edit distance in characters of each text from ``b``, all texts a letter at a time; over ``most`` some number over it."""
    longest = max(map(len, some))
    codes = np.array([[ord(c) for c in a] + [-1] * (longest - len(a)) for a in some])
    ends, own = np.array([len(a) for a in some]), np.array([ord(c) for c in b])
    place = np.arange(len(b) + 1)
    rows, found, left = np.repeat(place[None], len(some), 0), np.full(len(some), most + 1), np.arange(len(some))
    for i in range(longest):
        if i % 16 == 15:
            near = rows.min(axis=1) <= most
            rows, codes, ends, left = rows[near], codes[near], ends[near], left[near]
            if not len(left):
                break
        fresh = np.empty_like(rows)
        fresh[:, 0] = i + 1
        fresh[:, 1:] = np.minimum(rows[:, 1:] + 1, rows[:, :-1] + (own != codes[:, i, None]))
        fresh = np.minimum.accumulate(fresh - place, axis=1) + place
        rows = np.where((ends > i)[:, None], fresh, rows)
    found[left] = rows[:, -1]
    return found


def edited_lines(docs: list[tuple], least: float = 0.8) -> set[tuple]:
    """(doc_id, text, line number) of the lines that another one stands for, by edit similarity in characters alone."""
    at: dict[str, list] = {}
    for doc_id, text in docs:
        code = _signed(xxhash.xxh64_intdigest((text or "").encode(), 42))
        for n, line in enumerate((text or "").split("\n")):
            if norm := " ".join(normalise(line)):
                at.setdefault(norm, []).append(((doc_id is not None, doc_id, code, n), (doc_id, text, n)))
    by_length = sorted(at, key=len)
    sizes = np.array([len(x) for x in by_length])
    # An edit takes at most three triples of letters from a line.
    triples = np.zeros((len(by_length), 2048), np.int16)
    for i, x in enumerate(by_length):
        np.add.at(triples[i], [hash(x[k : k + 3]) % 2048 for k in range(len(x) - 2)], 1)
    links = []
    for j, b in enumerate(by_length):
        most = int(len(b) * (1 - least) + 1e-9)
        low = int(np.searchsorted(sizes, len(b) - most))
        more = np.maximum(triples[j] - triples[low:j], 0).sum(1) <= 3 * most
        some = [by_length[low + i] for i in np.flatnonzero(more)]
        if some:
            links += [(a, b) for a, d in zip(some, edit_distances(some, b, most), strict=True) if d <= most]
    members: dict[str, list] = {}
    for norm, root in groups(list(at), links).items():
        members.setdefault(root, []).extend(at[norm])
    return {place for places in members.values() for key, place in places if key != min(places)[0]}


def repeated_lines(docs: list[tuple], distance: int = 2, least: float = 0.8) -> set[tuple]:
    """(doc_id, text, line number) of the lines that another one stands for."""
    at: dict[tuple, list] = {}
    for doc_id, text in docs:
        if text is not None:
            code = _signed(xxhash.xxh64_intdigest(text.encode(), 42))
            for n, line in enumerate(text.split("\n")):
                if norm := normalise(line):
                    at.setdefault(norm, []).append(((doc_id is not None, doc_id, code, n), (doc_id, text, n)))
    prints = {x: simhash([xxhash.xxh64_intdigest(w.encode(), 42) for w in dict.fromkeys(x)]) for x in at}
    links = []
    for a, b in combinations(sorted(at), 2):
        longer = max(len(a), len(b))
        if (prints[a] ^ prints[b]).bit_count() <= distance and edit_distance(a, b) <= int(longer * (1 - least) + 1e-9):
            links.append((a, b))
    root = groups(list(at), links)
    members: dict[tuple, list] = {}
    for norm, places in at.items():
        members.setdefault(root[norm], []).extend(places)
    gone = set()
    for places in members.values():
        first = min(places)
        gone |= {place for key, place in places if key != first[0]}
    return gone


def without_lines(docs: list[tuple]) -> list[tuple]:
    gone = repeated_lines(docs)
    return [
        (i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, t, n) not in gone)) for i, t in docs
    ]


def repeated_bytes(texts: list[str | None], span: int = 200) -> list[set[int]]:
    count = Counter(b[i : i + span] for t in texts for b in [(t or "").encode()] for i in range(len(b) - span + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        out.append({j for i in range(len(b) - span + 1) if count[b[i : i + span]] > 1 for j in range(i, i + span)})
    return out


def targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed: dict = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s: float(most * sizes[s]) for s in free if share[s] > most * sizes[s]}
        if not above:
            return fixed | share
        fixed |= above
