"""Plain versions of the corpus operators, and the odd rows they are compared on."""

import hashlib
import random
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty, long, repeated, near and exact copies, shared passages."""
    rng = random.Random(5)
    vocabulary = ["ü" + str(k) if k % 9 == 0 else "w" + "abcdefgh"[k % 8] * (1 + k % 4) + "xyz"[k % 3] for k in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, base, item = prose(70), prose(300), prose(40)
    texts = [prose(rng.randint(1, 200)) for _ in range(20)]
    texts += [prose(30) + " " + passage + "\n" + prose(20) for _ in range(5)]
    texts += [base, base, base, base.replace(" ", "\n", 3), base + " tail", "head " + base]
    texts += [prose(60) + "\n" + item + "\n" + prose(10), item]
    texts += ["", "   \n\t ", "one", "a b", "a b c", "same line\nsame line\nsame line\n" + prose(60), "x " * 900, "q" * 700, "ab" * 400,
              " nbsp word x \x0b v\x0cf\r\n" + prose(55), prose(30_000), "### $$$ " * 80, "MIT", "Released under the MIT Licence.\n" + prose(5),
              "write a.b@c.example.org or +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111, 300.1.1.1 +12 9@"]
    table = [(k, t, ["en", "fr", None][k % 3], ["s1", "s2", "s3", None][k % 4 if k % 5 else 0], len(t)) for k, t in enumerate(texts)]
    table += [(None, base, "en", "s1", 1), (900, None, None, None, None), (901, None, "en", "s2", None), (902, base, None, None, 3), (902, base, None, None, 3),
              (903, passage, "en", "s1", 0), (-5, passage + " z", "fr", "s2", 0)]
    return table


def frame(spark, table=None):
    """The rows with further columns whose names the jobs use inside."""
    table = rows() if table is None else table
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as key", "'x' as size", "2 as part", "'t' as target", "3 as place", "4 as fp", "null as line", "5 as total")


def items() -> list[tuple]:
    table = rows()
    full = table[32][1].split()
    return [(7, table[31][1]), (11, " ".join(full[:13])), (3, "One."), (5, ""), (6, None), (None, "a b"), (11, " ".join(full[2:15])), (100, "w w w none of these words are there at all in any text x")]


def windows_removed(table, length=50):
    words = [WORD.findall(t or "") for _, t, *_ in table]
    ids = [LAST if r[0] is None else r[0] for r in table]
    least = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - length + 1):
            win = tuple(w[k: k + length])
            least[win] = min(least.get(win, i), i)
    out = []
    for r, i, w in zip(table, ids, words):
        gone = set()
        for k in range(len(w) - length + 1):
            if least[tuple(w[k: k + length])] < i:
                gone |= set(range(k, k + length))
        out.append((r[0], len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


def bytes_removed(table, length=200):
    data = [(t or "").encode() for _, t, *_ in table]
    seen = Counter(d[k: k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for r, d in zip(table, data):
        gone = bytearray(len(d))
        upto = 0
        for k in range(len(d) - length + 1):
            if seen[d[k: k + length]] > 1:
                a = max(k, upto)
                gone[a: k + length] = b"\1" * (k + length - a)
                upto = k + length
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((r[0], len(d), sum(gone), spans, sha(bytes(x for x, g in zip(d, gone) if not g))))
    return Counter(out)


def contamination(table, items, length=13):
    term = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for i, t in items:
        w = term.findall(lower(t or ""))
        for k in range(max(1, len(w) - length + 1) if w else 0):
            wins.setdefault(tuple(w[k: k + length]), set()).add(i)
    lengths = {len(w) for w in wins}
    out = []
    for r in table:
        w = term.findall(lower(r[1] or ""))
        hit, ids = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k: k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids |= wins[tuple(w[k: k + n])]
        ids.discard(None)
        out.append((r[0], len(w), len(hit), len(ids), sha(",".join(sorted(str(i) for i in ids))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


def fingerprint(text, width=3):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[k: k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints):
    """Smallest index per group of numbers within two bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def quality(table):
    out = []
    for r in table:
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
        again = {p for k in range(len(w) - 2) if grams[tuple(w[k: k + 3])] > 1 for p in (k, k + 1, k + 2)}
        n, chars, symbols, dup = len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
        base = n < 50 or 100 * len(again) > 50 * n
        kept = not (base or 10 * symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 20 * n)
        out.append((r[0], n, chars, symbols, dup, len(again), base, kept))
    return Counter(out)


def shingles(text, width=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k: k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def near_groups(texts):
    """Smallest index per group of texts linked at a Jaccard similarity of 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if root[a] != root[b] and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def without_boilerplate(table, ratio=0.07, least=3, page=None):
    """``page`` names the page of each row; by default each row is one."""
    page = list(range(len(table))) if page is None else page
    blanks = " \t\r\x0b\x0c"
    pages = Counter(site for site, _ in {(r[3], p) for r, p in zip(table, page)})
    counts = Counter((site, line) for site, line, _ in {(r[3], x.strip(blanks), p) for r, p in zip(table, page) for x in (r[1] or "").split("\n") if x.strip(blanks)})
    bad = {k for k, n in counts.items() if n >= least and n > ratio * pages[k[0]]}
    return [(*r[:1], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(blanks)) not in bad), *r[2:]) for r in table]
