"""Near copies and boilerplate of the pipeline, against brute force over all pairs."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callweave.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


groups = brute.near_groups


def edited(rng, text, most):
    w = text.split()
    for k in rng.sample(range(len(w)), rng.randint(0, most)):
        w[k] = f"new{rng.random()}"
    return " ".join(w)


def planted():
    rng = random.Random(11)
    bases = [" ".join(f"v{rng.randint(0, 900)}" for _ in range(rng.randint(60, 300))) for _ in range(25)]
    texts = [edited(rng, b, 12) for b in bases for _ in range(4)] + [edited(rng, bases[0], 6) for _ in range(120)]
    return texts + [r[1] for r in brute.rows()]


@pytest.mark.parametrize("crowded", [64, 8])
def test_groups_are_those_of_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    texts = planted()
    table = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in minhash.grouped(spark.createDataFrame(table, SCHEMA).repartition(4)).collect()}
    wanted = groups(texts)
    assert len(set(wanted)) < len(texts) - 100 and [got[k] for k in range(len(texts))] == wanted


def test_crowded_cells_lose_no_link(spark, monkeypatch):
    """One family holds a third of all texts; others share its cells, are near to none of its leaders, and are near to each other."""
    monkeypatch.setattr(minhash, "CROWDED", 3)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(3)
    base = [f"v{k}" for k in range(300)]
    texts = [edited(rng, " ".join(base), 4) for _ in range(60)]
    for family in range(25):
        half = " ".join([f"f{family}x{k}" if k >= 210 + 3 * (family % 9) else w for k, w in enumerate(base)])
        texts += [half] + [edited(rng, half, 6) for _ in range(2)]
    chain = list(base)
    for k in range(30):  # each link near to the one before, the ends are far from each other
        chain[20 + 7 * k: 23 + 7 * k] = [f"c{k}a", f"c{k}b", f"c{k}c"]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    table = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    led = []
    plain = minhash.stragglers
    monkeypatch.setattr(minhash, "stragglers", lambda *a: led.append(plain(*a)) or led[-1])
    got = {r.doc_id: r.component_id for r in minhash.grouped(spark.createDataFrame(table, SCHEMA).repartition(4)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(texts) and led and led[0].count() > 0


def test_stragglers_meet_every_other_group(spark):
    met = spark.createDataFrame([(1, k, 200, 0) for k in range(200)] + [(2, k, 2, 0) for k in range(2)], "cell long, digest long, n long, least long")
    roots = spark.createDataFrame([(k, 0) for k in range(1, 190)], "node long, root long")
    sizes = spark.createDataFrame([(k, 1000 if k == 195 else 80) for k in range(200)], "digest long, size int")
    for block in (7, 4096):
        minhash.BLOCK, before = block, minhash.BLOCK
        got = [(r.a, r.b) for r in minhash.stragglers(met, roots, sizes).collect()]
        minhash.BLOCK = before
        alone = [k for k in range(190, 200) if k != 195]
        assert sorted(got) == sorted([(a, b) for b in alone for a in range(190)] + [(a, b) for a in alone for b in alone if a < b])


def test_groups_of_odd_rows(spark):
    table = brute.rows()
    got = Counter((r.doc_id, r.component_id) for r in minhash.grouped(brute.frame(spark).repartition(5), key=F.xxhash64("doc_id", "text")).collect())
    roots, least = groups([r[1] for r in table]), {}
    for r, root in zip(table, roots):
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    assert got == Counter((r[0], least[root]) for r, root in zip(table, roots))
    assert minhash.grouped(brute.frame(spark, [])).count() == 0


def test_stage_drops_near_copies_that_simhash_leaves(spark):
    rng = random.Random(2)
    base = " ".join(f"v{rng.randint(0, 900)}" for _ in range(200))
    w = base.split()
    near = " ".join(w[:50] + ["x"] + w[51:120] + ["y"] + w[121:])  # 186 of 206 shingles
    far = " ".join(x if k % 20 else "z" for k, x in enumerate(w))
    assert (brute.fingerprint(base) ^ brute.fingerprint(near)).bit_count() > 2
    docs = spark.createDataFrame([(1, base, "en", "s", 0), (2, near, "en", "s", 0), (3, far, "en", "s", 0)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3]


def test_lines_stage_keeps_what_is_copied(spark):
    rng = random.Random(4)

    def page(n=6):
        return "\n".join(" ".join(f"v{rng.randint(0, 900)}" for _ in range(20)) for _ in range(n))

    base, other = page(), page(20)
    near = []
    for k in range(10):
        w = other.split(" ")
        w[17 * k + 9] = f"edit{k}"
        near.append(" ".join(w))
    own = ["menu of the site\n" + page() for _ in range(30)]
    texts = own + [base] * 30 + near
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, "").collect()}
    wanted = [t.split("\n", 1)[1] for t in own] + [base] * 30 + near
    assert [got[k].text for k in range(len(texts))] == wanted and all(r.n_chars == len(r.text) for r in got.values())
    left = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert len(left) == 32 and {r.text for r in left} >= {base, near[0]}


def test_a_common_passage_brings_no_pairs(spark, monkeypatch):
    """Four hundred texts share a passage of half their words and are near to nobody: their count of pairs stays below their number."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [passage + " " + " ".join(f"t{n}x{rng.random()}" for _ in range(rng.randint(40, 70))) for n in range(400)]
    texts += [edited(rng, texts[k], 4) for k in range(0, 40, 2)]
    seen, plain = [], (minhash.proposed, minhash.stragglers)
    monkeypatch.setattr(minhash, "proposed", lambda *a: seen.append(plain[0](*a)) or seen[-1])
    monkeypatch.setattr(minhash, "stragglers", lambda *a: seen.append(plain[1](*a)) or seen[-1])
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.grouped(docs).collect()}
    assert [got[k] for k in range(len(texts))] == groups(texts)
    assert len(seen) == 2 and seen[1].count() < len(texts) < 400 * 399 / 50


def test_stage_links_by_fingerprints_first(spark, monkeypatch):
    """With no bands at all the stage still finds what SimHash links, and verifies it."""
    rng = random.Random(12)
    base = [f"v{rng.randint(0, 900)}" for _ in range(3000)]
    near = base[:1500] + ["x"] + base[1501:]
    other = [f"w{rng.randint(0, 900)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join(near), " ".join(other), "a b", "c d", "", None]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(minhash, "proposed", lambda met: met.select(F.col("digest").alias("a"), F.col("digest").alias("b")).limit(0))
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 2, 3, 4, 5]
