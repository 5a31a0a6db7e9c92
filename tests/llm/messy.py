"""Small awkward inputs shared by the corpus tests, and brute-force versions to hold results against."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, keys string, rep long, root long, base string, "
          "terms string, n_words string, kept string, copy string, host string, rule string, h1 string, __id string")


def words(text):
    return WORD.findall(text or "")


def rows(texts, start=0):
    """Rows of SCHEMA; the extra columns clash with names that operators use inside."""
    return [(start + i, t, "en", "s", len(t or ""), "x", 7, 8, "b", "t", "w", "k", "c", "h", "r", "h", "i")
            for i, t in enumerate(texts)]


def table(spark, texts, start=0):
    return spark.createDataFrame(rows(texts, start), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [None, "", " ", "\n\n", "one", "one two", "a\tb\n c  d\r\n", "é 😀 ñ — “quoted” text", "x" * 5000, LONG,
           "same text here for ties and copies of rows", "same text here for ties and copies of rows"]


def removed_words(docs, window):
    """doc_id -> (n_words, n_removed, kept_sha256) by looking every window up."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen:
                gone[s:s + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def near_classes(docs, threshold=0.8, n=5):
    """doc_id -> (class_id, n_links) from every pair that shares an n-gram."""
    def grams(text):
        w = words(text)
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in docs]
    where, links = collections.defaultdict(list), collections.Counter()
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = collections.Counter()
        for g in s:
            shared.update(where[g])
            where[g].append(i)
        for j, k in shared.items():
            if k / (len(s) + len(sets[j]) - k) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (least[find(i)], links[i]) for i, (d, _) in enumerate(docs)}


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII:
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15
                    or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)
