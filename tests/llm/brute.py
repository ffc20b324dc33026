"""Plain restatements to hold the operators against."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def repetition(text):
    w = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def repetition_verdict(text, ngrams, line_limit, line_char_limit):
    """(largest share of word characters in later n-grams, share of later lines, share of their characters, kept)."""
    w = WORD.findall(text)
    total, over, worst = max(sum(map(len, w)), 1), False, 0.0
    for n, limit in ngrams.items():
        seen, covered = set(), set()
        for i in range(len(w) - n + 1):
            gram = tuple(w[i : i + n])
            if gram in seen:
                covered |= set(range(i, i + n))
            seen.add(gram)
        share = sum(len(w[i]) for i in covered) / total
        worst, over = max(worst, share), over or share > limit
    lines, seen, again = [x for x in text.split("\n") if WORD.search(x)], set(), []
    for x in lines:
        if x in seen:
            again.append(x)
        seen.add(x)
    by_line, by_char = len(again) / max(len(lines), 1), sum(map(len, again)) / max(sum(map(len, lines)), 1)
    n_words, _, _, _, repeated = repetition(text)
    failed = n_words < 20 or 100 * repeated > 30 * n_words
    return worst, by_line, by_char, not (failed or over or by_line > line_limit or by_char > line_char_limit)


def shingles(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """[(number of shingles, smallest id reachable)] of rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def repeats(texts, least):
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(t[i : i + least] for t in data for i in range(len(t) - least + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if counts[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def private(text):
    def sound(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and luhn % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text) if sound(k, m.group())]
