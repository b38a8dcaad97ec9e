"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def greedy_tokens(text: str, pieces: set[str], marker: str) -> tuple[int, int]:
    words, n = BLANK.findall(text or ""), 0
    for w in words:
        w, at = marker + w, 0
        while at < len(w):
            stop = next((e for e in range(len(w), at, -1) if w[at:e] in pieces), 0)
            n += 1 if stop else len(w[at].encode())
            at = stop or at + 1
    return len(words), n


def simhash(text: str | None, shingle: int = 4) -> int:
    words = BLANK.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Groups:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def near_classes(docs: list[tuple[int, str | None]], bits: int = 4) -> dict[int, tuple[str, int]]:
    prints = {i: simhash(t) for i, t in docs}
    g = Groups()
    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            g.join(a, b)
    return {i: (f"{prints[i]:016x}", g.find(i)) for i in prints}


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def contamination(text: str | None, items: list[tuple[int, str | None]], size: int = 10) -> tuple[int, list[int], list[str]]:
    doc, hit, names = item_words(text), set(), set()
    for name, item in items:
        w = item_words(item)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for at in range(len(doc) - n + 1):
                if doc[at:at + n] == w[i:i + n]:
                    hit.update(range(at, at + n))
                    names.add(str(name))
    return len(doc), sorted(hit), sorted(names)


def units(text: str) -> list[str]:
    """Lines; each but the first brings its line feed."""
    return [("\n" if i else "") + line for i, line in enumerate(text.split("\n"))]


def line_words(unit: str) -> list[str]:
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", unit.lower(), flags=re.ASCII) if w]


def edit_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edits(a: str, b: str) -> int:
    """The same distance for long texts: one column of the table in the bits of two whole numbers."""
    if not a:
        return len(b)
    where, full, top = defaultdict(int), (1 << len(a)) - 1, 1 << (len(a) - 1)
    for i, c in enumerate(a):
        where[c] |= 1 << i
    up, down, score = full, 0, len(a)
    for c in b:
        hit = where.get(c, 0) | down
        diagonal = ((((hit & up) + up) ^ up) | hit) & full
        right_up, right_down = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = ((right_up << 1) | 1) & full, (right_down << 1) & full
        up, down = (right_down | ~(diagonal | right_up)) & full, right_up & diagonal
    return score


def line_dedup(docs: list[tuple[int, str | None]], similarity: float = 0.8) -> dict[int, tuple[str | None, int, int]]:
    """Every pair of whole normalised lines is compared in characters, without any condition on keys."""
    at = [(i, pos, " ".join(w)) for i, t in docs if t is not None for pos, u in enumerate(units(t)) if (w := line_words(u))]
    g = Groups()
    for a, b in combinations(sorted({x for _, _, x in at}), 2):
        allowed = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
        # letters that only one line has cost an edit at least
        if abs(len(a) - len(b)) <= allowed and sum(max(0, a.count(c) - b.count(c)) for c in set(a)) <= allowed and edits(a, b) <= allowed:
            g.join(a, b)
    first, gone = {}, defaultdict(set)
    for i, pos, x in sorted(at):
        if first.setdefault(g.find(x), (i, pos)) != (i, pos):
            gone[i].add(pos)
    out = {}
    for i, t in docs:
        if t is None:
            out[i] = (None, 0, 0)
            continue
        kept = "".join(u for pos, u in enumerate(units(t)) if pos not in gone[i])
        out[i] = (kept[1:] if 0 in gone[i] and kept[:1] == "\n" else kept, len(units(t)), len(gone[i]))
    return out


def substring_dedup(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    words = {i: BLANK.findall(t or "") for i, t in docs}
    least: dict[tuple, int] = {}
    for i in sorted(words, reverse=True):
        for k in range(len(words[i]) - window + 1):
            least[tuple(words[i][k:k + window])] = i
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if least[tuple(w[k:k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def url_parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:stop], rest[stop:]
    end = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return host.translate(ASCII_LOWER), path[:end]


def url_rule(host: str, path: str, rules) -> tuple[str, str] | None:
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return best and (best[1] + best[2], best[0])


def best_fit(lengths: list[int], window: int) -> list[int]:
    """Fill of each window, by trying every open window."""
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(window - n)
    return sorted(window - r for r in room)
