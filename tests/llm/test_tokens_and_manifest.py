"""Alignment, manifest and packing against plain versions, over odd rows, repeated rows and empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callweave.llm import alignment, cutting_stock, merkle, packing
from callweave.llm.queries import QUERIES

ODD = ["<|endoftext|> inside<|endoftext|>text", "non breaking blanks", "é combining, Ünïcödé ŒUVRE ĀĂ İstanbul ΣΑΣ", "日本語のテキスト 한국어", "a\x1cb\x00c", "▁ piece sign",
       "it's we'll I'M 12345 ª º µ ÷ ×", "🙂🙃 emoji", "tabs\t\t\tand\r\n\r\nlines\n\n\n", "   lead and trail   ", "x" * 5000, " " * 3000, "ﬁ ligature ① ½"]


@pytest.fixture(scope="module")
def table():
    rows = [(k, t) for k, (_, t, *_) in enumerate(brute.rows()) if t is None or len(t) < 20_000]
    return rows + [(2000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (5, "again"), (5, "again"), (2100, "of the of the " * 500)]


@pytest.fixture(scope="module")
def docs(spark, table):
    df = spark.createDataFrame(table, "doc_id long, text string")
    return df.selectExpr("*", "1 as id", "'x' as segment", "2 as part", "3 as rank", "4 as length", "5 as h", "6 as g", "'en' as lang", "'s' as source", "7 as n_chars").repartition(4)


# --- alignment ---------------------------------------------------------------------------
def plain_alignment(table):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    out, links = [], Counter()
    for doc_id, text in table:
        ids_a, ids_b, own, groups = [], [], [], []
        if text:
            whole = " " + text
            ids_a, ids_b = a.encode(whole, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
            pieces = [b.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
            if b"".join(bytes_a) != whole.encode() or b"".join(bytes_b) != whole.encode():
                ids_a, ids_b = [], []
            else:
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                at_b = {e: i for e, i in zip(ends_b, ids_b)}
                own = [(i, at_b[e]) for e, i in zip(ends_a, ids_a) if e in at_b]
                shared = sorted(set(ends_a) & set(ends_b))
                for low, high in zip([0, *shared], shared):
                    groups.append(",".join(str(i) for e, i in zip(ends_a, ids_a) if low < e <= high) + "|"
                                  + ",".join(str(i) for e, i in zip(ends_b, ids_b) if low < e <= high))
        links.update(own)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), own, ";".join(groups)))
    top = defaultdict(int)
    for (_, y), n in links.items():
        top[y] = max(top[y], n)
    rows = Counter((d, x, y, g, len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(t.encode()).hexdigest() if t else "")
                   for d, x, y, g, own, t in out)
    return rows, links, out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("segment", [8 << 20, 3000])
def test_alignment(docs, table, monkeypatch, segment):
    monkeypatch.setattr(alignment, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(alignment, "RUN_BYTES", segment // 2)
    wanted, links, out = plain_alignment(table)
    assert sum(1 for r in out if not r[1] and r[0] is not None and r[0] >= 2000) > 0 and len(links) > 150
    got = alignment.aligned(docs).select(*COLUMNS)
    assert Counter(map(tuple, got.collect())) == wanted


def test_alignment_pairs_and_groups(docs, table):
    _, links, out = plain_alignment(table)
    in_docs = Counter(p for r in out for p in set(r[4]))
    segments = alignment.index(docs, with_groups=True)
    pairs = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_counts(alignment.segment_pairs(segments)).collect()}
    assert pairs == {p: (in_docs[p], n) for p, n in links.items()}
    texts = Counter((d.id, d.groups) for r in segments.collect() for d in r.docs)
    assert texts == Counter((r[0], r[5]) for r in out)


def test_bitmap_planes_round_trip():
    rng = np.random.default_rng(3)
    code = np.unique(rng.integers(0, 40 * 900, 9000) * (rng.random(9000) < 0.7))
    pair, doc, times = code // 900, code % 900, rng.integers(1, 70, len(code))
    planes = alignment.merged(pair, doc, times, 40, 900)
    total = np.zeros((40, 900), dtype=int)
    for k, plane in enumerate(planes):
        x, d = alignment.postings(plane, 900)
        assert (alignment.popcounts(plane, 900) == np.bincount(x, minlength=40)).all()
        total[x, d] += 1 << k
    wanted = np.zeros((40, 900), dtype=int)
    wanted[pair, doc] = times
    assert (total == wanted).all() and any(p["bits"] for p in planes) and any(p["docs"] for p in planes)


def test_long_runs_of_blanks():
    text = "a" + " " * 3_000_000 + "b"
    enc = alignment._encoder(alignment.vocabularies())
    assert b"".join(enc.bytes_a[i] for i in enc.encode_a(text)) == text.encode()


def test_byte_ranks_equal_the_json(spark, folder):
    enc = alignment._encoder(alignment.vocabularies())
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = [" " + (r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    assert [enc.encode_a(t) for t in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


# --- manifest ----------------------------------------------------------------------------
def plain_manifest(rows):
    def H(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def tree(nodes):
        """Root and, per node, its steps."""
        steps, place = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for s, p in zip(steps, place):
                run = nodes[p // 8 * 8: p // 8 * 8 + 8]
                s.append(("".join(run[: p % 8]), "".join(run[p % 8 + 1:])))
            nodes, place = [H(*nodes[k: k + 8]) for k in range(0, len(nodes), 8)], [p // 8 for p in place]
        return nodes[0], steps

    groups = defaultdict(list)
    for r in rows:
        bad = (*r[:4], brute.lower(r[4])) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r
        groups[r[2]].append((r[0], leaf(r), leaf(bad)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    root, above = tree([trees[g][0] for g in order])
    out = Counter()
    for g, more in zip(order, above):
        for (doc_id, own, bad), steps in zip(groups[g], trees[g][1]):
            h = bad
            for low, high in steps + more:
                h = H(low, h, high)
            out[(doc_id, own, trees[g][0], root, H(*[x + y for x, y in steps + more]), h, h == root)] += 1
    return out


@pytest.mark.parametrize("depth", [4, 1, 2])
def test_manifest(spark, tmp_path, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 8**depth)
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in brute.rows()] + [(k, "S", "xx" if k % 2 else f"l{k % 11}", k, f"Text {k % 7}") for k in range(600)] + [(3, "S", "de", 1, "Alone Ü")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr(
        "*", "1 as id", "2 as g", "3 as slot", "4 as n", "5 as h", "6 as block", "7 as steps", "8 as part", "9 as at")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_manifest_of_one_row_and_none(spark):
    one = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == hashlib.sha256(b"-----").hexdigest() and row.steps == []
    assert merkle.manifest(one.limit(0)).count() == 0


# --- packing -----------------------------------------------------------------------------
def check_packing(rows, texts, capacity):
    """Every id in one piece, sequences full or a power of two, right checksums."""
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    kinds = Counter((d, tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in texts)
    wanted = Counter()
    for (doc_id, ids), n in kinds.items():
        wanted[(doc_id, len(ids))] += n
    got = Counter()
    for r in rows:
        got[(r.doc_id, r.doc_tokens)] += r.length / r.doc_tokens
    assert {k: round(v, 6) for k, v in got.items()} == dict(wanted)
    known = defaultdict(list)
    for doc_id, ids in kinds:
        known[(doc_id, len(ids))].append(ids)
    for r in rows:
        assert any(zlib.crc32(np.array(i[r.start: r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for i in known[(r.doc_id, r.doc_tokens)])
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill[r.sequence_id] == r.offset and r.length > 0
        fill[r.sequence_id] += r.length
    assert all(n == capacity or n & (n - 1) == 0 and n < capacity for n in fill.values()) and sorted(fill) == list(range(len(fill)))


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, table, capacity):
    check_packing(packing.packed(docs, capacity=capacity).collect(), table, capacity)


def test_packing_with_ids(docs):
    rows = packing.packed(docs, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert Counter((r.doc_id, r.length) for r in packing.packed(docs).collect()) == Counter((r.doc_id, r.length) for r in rows)


def test_packing_query_and_few_cuts(spark, folder):
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op13_packing"](spark, folder).collect()
    check_packing(rows, texts, 2048)
    assert len(rows) - sum(-(-r.doc_tokens // 2048) for r in rows if r.start == 0) < 0.5 * len(texts)


def test_packing_nothing(docs):
    assert packing.packed(docs.limit(0)).count() == 0 and alignment.aligned(docs.limit(0)).count() == 0


def test_layout_places_every_piece_once():
    rng = np.random.default_rng(2)
    cases = [rng.integers(1, rng.integers(2, 33) + 1, rng.integers(1, 80)) for _ in range(60)] + [np.full(9, 32), np.full(50, 20), np.array([5]), rng.integers(1, 1025, 4000)]
    for lengths in cases:
        capacity = 32 if lengths.max() <= 32 else 1024
        plan = cutting_stock.layout(dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)])), capacity)
        seen, ranks = Counter(), []
        for n in lengths.tolist():
            ranks.append(seen[n])
            seen[n] += 1
        sequence, offset, _ = cutting_stock.places(plan, lengths, np.array(ranks))
        pieces = []
        for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist()):
            pieces += [(s, o, n)] if s >= 0 else [(x[2], x[3], x[1]) for x in cutting_stock.stretches(plan, o, n)]
        fill = Counter()
        for s, o, n in sorted(pieces):
            assert fill[s] == o
            fill[s] += n
        assert sum(fill.values()) == lengths.sum() and all(n == capacity or n & (n - 1) == 0 for n in fill.values())


def test_patterns_are_near_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.arange(10, 210)
    need = rng.integers(50, 500, len(lengths))
    found = cutting_stock.patterns(lengths, need.astype(float), 1024)
    assert all(lengths @ copies <= 1024 for copies, _ in found)
    used = sum(copies * uses for copies, uses in found)
    assert (used <= need).all() and sum(uses for _, uses in found) * 1024 < 1.02 * (lengths @ used)


def test_knapsack():
    rng = np.random.default_rng(5)
    for _ in range(30):
        values = np.where(rng.random(9) < 0.6, rng.random(9), -np.inf)
        best, last = cutting_stock.knapsack(values, 25)
        plain = [0.0]
        for room in range(1, 26):
            plain.append(max([plain[-1]] + [plain[room - n] + values[n - 1] for n in range(1, min(9, room) + 1)]))
        assert np.allclose(best, plain)
        taken = cutting_stock._taken(last, 25)
        assert sum(taken) <= 25 and np.isclose(sum(values[n - 1] for n in taken), best[25])
