"""Personal data by a semi-Markov conditional random field.

Stretches of text near digits or ``@`` are cut into tokens.  Every run of up to ``MOST_TOKENS`` tokens is a candidate entity; it is
scored as a whole (shape, digits, separators, length, the word before it) for each type, and a dynamic program over the tokens picks
the best joint choice of boundaries and types, single tokens outside entities included.  Weights are fitted by maximum
likelihood (forward and backward sums over all segmentations) on a bounded sample of stretches labelled by patterns.

The exact patterns (``base_spans``) always stand; the field adds spans that overlap none of them: secrets, and numbers of the
shape of a kind that its pattern refuses.  All matching is linear in the text.

Null and empty texts have no spans.  Rows are judged one by one; repeated rows, ties and null ids need no rule.  A table without a
single labelled stretch fits no field and gives the base spans.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.batches import chunks, text_bytes

KINDS = ["email", "ip", "card", "phone", "secret"]
MOST_TOKENS = 16
SAMPLE_ROWS = 400  # documents with stretches, those of the smallest id hashes, that the field is fitted on
CONTEXT = 2  # words kept on either side of a word with a digit or @
BLOCK_TOKENS = 512  # scored at once
EPOCHS, RATE, DECAY = 40, 1.0, 1e-3

# The patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|api_?key)\s*[=:]\s*[\"']?([0-9a-z_\-]{20,})")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        x = int(digit)
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[tuple[int, int]]:
    """The address pattern, found from each @ outwards."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", domain.end() if domain else at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def stretches(text: str) -> list[tuple[int, int]]:
    """Where words with a digit or @ stand, with ``CONTEXT`` words on either side; overlapping ones are one."""
    words = [m.span() for m in _WORD.finditer(text)]
    found: list[list[int]] = []
    for k, (a, b) in enumerate(words):
        if any("0" <= c <= "9" or c == "@" for c in text[a:b]):
            low, high = max(0, k - CONTEXT), min(len(words), k + CONTEXT + 1)
            if found and low <= found[-1][1]:
                found[-1][1] = high
            else:
                found.append([low, high])
    return [(words[low][0], words[high - 1][1]) for low, high in found]


FEATURES = ["bias", "tokens", "digits_1_3", "digits_4_9", "digits_10_13", "digits_14_19", "digits_20", "only_digits", "at", "at_dot", "dots_3", "plus_first",
            "brackets", "hyphen", "blank", "letters", "hex_long", "quoted_before", "assigned_before", "equals", "odd_end", "luhn", "small_parts", "symbol"]
_HEX = re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}")


def features(text: str, before: str) -> list[float]:
    """Whole-span features; ``before`` is what stands shortly before the span."""
    digits = sum("0" <= c <= "9" for c in text)
    letters = any(c.isalpha() for c in text)
    at, dots = text.count("@") == 1, text.count(".")
    inner = text.strip(".,;:!?\"'")
    parts = inner.split(".")
    return [1.0, len(text) / 20, 1 <= digits <= 3, 4 <= digits <= 9, 10 <= digits <= 13, 14 <= digits <= 19, digits >= 20, digits == len(text), at,
            at and "." in text.partition("@")[2], dots == 3 and not letters, text[0] == "+" and digits >= 7, "(" in text and ")" in text, "-" in text, " " in text,
            letters, _HEX.fullmatch(text) is not None, before.rstrip().endswith(("\"", "'")), bool(re.search(r"[=:]\s*[\"']?$", before)), "=" in text,
            inner != text, 14 <= digits <= 19 and luhn(_digits(text)),
            len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts), any(c in "#*$%&|<>\"'" for c in text)]


def tokens_of(text: str, low: int, high: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, low, high)]


def segments(text: str, tokens: list[tuple[int, int]], first: int, last: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate segments (first, end token) that start at tokens first..last-1, in that order, and their features."""
    spans, rows = [], []
    for i in range(first, last):
        a, marked = tokens[i][0], False
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            x, b = tokens[j]
            marked = marked or any("0" <= c <= "9" or c == "@" for c in text[x:b])
            if j > i and "\n" in text[tokens[j - 1][1]: x]:
                break  # an entity stands on one line
            if marked:
                spans.append((i, j + 1))
                rows.append(features(text[a:b], text[max(0, a - 12): a]))
    return spans, np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))


def best_spans(text: str, low: int, high: int, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best segmentation; a token outside entities scores 0.

    Segments are scored block by block and forgotten, so memory follows the tokens, however long the stretch is.
    """
    tokens = tokens_of(text, low, high)
    value = [0.0] + [-np.inf] * len(tokens)
    back: list[tuple[int, int] | None] = [None] * (len(tokens) + 1)
    for block in range(0, len(tokens), BLOCK_TOKENS):
        last = min(len(tokens), block + BLOCK_TOKENS)
        spans, rows = segments(text, tokens, block, last)
        scores = rows @ weights.T
        kinds, tops = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
        s = 0
        for i in range(block, last):
            if value[i] >= value[i + 1]:
                value[i + 1], back[i + 1] = value[i], None
            while s < len(spans) and spans[s][0] == i:
                end = spans[s][1]
                if value[i] + tops[s] > value[end]:
                    value[end], back[end] = value[i] + tops[s], (i, kinds[s])
                s += 1
    found, j = [], len(tokens)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            found.append((tokens[i][0], kind, tokens[j - 1][1]))
            j = i
    return found[::-1]


class Lattice:
    """All candidate segments of a short stretch, to fit on: token bounds, (first, end) token of each segment, and its features."""

    def __init__(self, text: str):
        self.tokens = tokens_of(text, 0, len(text))
        self.spans, self.rows = segments(text, self.tokens, 0, len(self.tokens))
        self.ending: list[list[int]] = [[] for _ in range(len(self.tokens) + 1)]
        self.starting: list[list[int]] = [[] for _ in range(len(self.tokens) + 1)]
        for s, (i, j) in enumerate(self.spans):
            self.ending[j].append(s)
            self.starting[i].append(s)

    def gradient(self, weights: np.ndarray, gold: list[tuple[int, int]]) -> np.ndarray:
        """Observed minus expected features, for gold segments (segment, kind)."""
        n, scores = len(self.tokens), self.rows @ weights.T
        if not len(scores):
            return np.zeros_like(weights)
        total = np.logaddexp.reduce(scores, axis=1)
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[self.spans[s][0]] + total[s] for s in self.ending[j]]])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *[behind[self.spans[s][1]] + total[s] for s in self.starting[i]]])
        first, last = np.array(self.spans).T
        chance = np.exp(scores + (ahead[first] + behind[last] - ahead[n])[:, None])
        step = -chance.T @ self.rows
        for s, kind in gold:
            step[kind] += self.rows[s]
        return step


def silver(text: str) -> list[tuple[int, int, int]]:
    """Labels to fit on: the exact patterns, numbers of the length of a card, and values assigned to a secret's name."""
    found = base_spans(text)
    taken = [(a, b) for a, _, b in found]
    extra = [(m.start(1), 4, m.end(1)) for m in SECRET.finditer(text)]
    extra += [(m.start(), 2, m.end()) for m in re.finditer(r"(?<![0-9A-Za-z.+-])[0-9]{14,19}(?![0-9A-Za-z])", text)]
    return sorted(found + [(a, k, b) for a, k, b in extra if not any(a < y and x < b for x, y in taken)])


def fit(texts: list[str]) -> np.ndarray | None:
    """Weights per kind and feature, by gradient ascent with decay; None without labels."""
    examples = []
    for text in texts:
        labels = silver(text)
        lattice = Lattice(text)
        where = {(lattice.tokens[i][0], lattice.tokens[j - 1][1]): s for s, (i, j) in enumerate(lattice.spans)}
        gold = [(where[a, b], kind) for a, kind, b in labels if (a, b) in where]
        if len(gold) == len(labels):
            examples.append((lattice, gold))
    if not any(gold for _, gold in examples):
        return None
    weights, speed = np.zeros((len(KINDS), len(FEATURES))), np.full((len(KINDS), len(FEATURES)), 1e-6)
    weights[:, 0] = -3.0  # what is not like an example is no entity
    for _ in range(EPOCHS):
        step = sum(lattice.gradient(weights, gold) for lattice, gold in examples) / len(examples) - DECAY * weights
        speed += step * step
        weights = weights + RATE * step / np.sqrt(speed)
    return weights


def spans_of(text: str, weights: np.ndarray | None) -> tuple[list, list]:
    """The base spans, and all spans: those and what the field adds beside them."""
    base = base_spans(text)
    if weights is None:
        return base, base
    found = []
    for low, high in stretches(text):
        found += best_spans(text, low, high, weights)
    every, k = list(base), 0
    reach = np.maximum.accumulate([b for _, _, b in base]) if base else []
    for a, kind, b in found:
        while k < len(base) and base[k][0] < b:
            k += 1
        if k == 0 or reach[k - 1] <= a:
            every.append((a, kind, b))
    return base, sorted(every)


def _marked_rows(batch: pa.RecordBatch) -> np.ndarray:
    """Rows whose text holds a digit or @; in the others there is nothing to find."""
    data, offsets = text_bytes(batch.column("text"))
    hits = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    return np.flatnonzero(hits[offsets[1:]] > hits[offsets[:-1]])


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sample(docs: DataFrame, most: int = SAMPLE_ROWS) -> list[str]:
    """Stretches to fit on: the first of each of at most ``most`` documents, those of the smallest id hashes."""

    def first(batches):
        for batch in chunks(batches):
            rows = _marked_rows(batch)
            texts = [batch.column("text")[int(k)].as_py() for k in rows]
            bounds = [stretches(t)[0] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array([t[a:b] for t, (a, b) in zip(texts, bounds)], type=pa.string())],
                                             names=["doc_id", "stretch"])

    found = _picked(docs).mapInArrow(first, "doc_id long, stretch string").where(F.length("stretch") <= 400)
    return [row.stretch for row in found.orderBy(F.xxhash64("doc_id"), "doc_id", "stretch").limit(most).collect()]


def scanned(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base (spans of the exact patterns) and spans (all), each a list of (kind, start, end)."""
    weights = fit(sample(docs))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def listed(spans):
        return [{"kind": KINDS[kind], "start": a, "end": b} for a, kind, b in spans]

    def scan(batches):
        for batch in chunks(batches):
            base, every = [[]] * batch.num_rows, [[]] * batch.num_rows
            for k in _marked_rows(batch):
                found = spans_of(batch.column("text")[int(k)].as_py(), weights)
                base[k], every[k] = listed(found[0]), listed(found[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, type=pa.list_(span)), pa.array(every, type=pa.list_(span))],
                                             names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return _picked(docs).mapInArrow(scan, f"doc_id long, base {kind}, spans {kind}")


def redacted(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and text, each span replaced by its kind in brackets (overlapping spans as one)."""
    weights = fit(sample(docs))

    def mask(batches):
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            for k in _marked_rows(batch):
                out, free = [], 0
                for a, kind, b in spans_of(texts[k], weights)[1]:
                    if a >= free:
                        out += [texts[k][free:a], f"[{KINDS[kind]}]"]
                    free = max(free, b)
                texts[k] = "".join(out) + texts[k][free:]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return _picked(docs).mapInArrow(mask, "doc_id long, text string")
