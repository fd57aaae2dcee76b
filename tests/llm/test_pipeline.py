"""The pipeline and the registered queries without SQL twins, against plain versions."""

import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callweave.llm.queries import QUERIES
from callweave.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_stages(table, items):
    one = [r for r in table if next(iter(brute.quality([r])))[-1]]
    two = [(*r[:4], None if r[1] is None else len(r[1])) for r in brute.without_boilerplate(one, page=brute.near_groups([r[1] for r in one]))]
    roots = brute.near_groups([r[1] for r in two])
    first = {}
    for r, root in zip(two, roots):
        if root not in first or (r[0] is None, r[0] or 0) < (first[root][0] is None, first[root][0] or 0):
            first[root] = r
    three = list(first.values())
    tainted = {r for r in three if next(iter(brute.contamination([r], items)))[-1]}
    return one, two, three, [r for r in three if r not in tainted]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    table = brute.rows()
    more = [(1000 + k, f"shared line of all pages\n{r[1]}" if k % 2 else r[1], "en", "s9", len(r[1])) for k, r in enumerate(table) if r[1] and len(r[1]) > 400]
    table = table + more
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(brute.items(), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, table


def test_stages(spark, data):
    folder, table = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wanted = plain_stages(table, brute.items())
    assert len(wanted[0]) < len(table) and wanted[1] != wanted[0] and len(wanted[2]) < len(wanted[1]) and len(wanted[3]) < len(wanted[2])
    for (name, stage), rows in zip(corpus_pipeline.STAGES, wanted):
        docs = cut(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS, name
        assert Counter(map(tuple, docs.collect())) == Counter(rows), name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(tuple(r)[:5] for r in mixed) == Counter(wanted[3])
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, mixed))
    taken, target = Counter(), {}
    for r in mixed:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r["size"] == len(brute.WORD.findall(r.text or "")) and r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= max(8, 0.01 * target[s]) for s in target)


def test_stages_on_repeated_rows(spark, data):
    folder, _ = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.union(docs)
    assert corpus_pipeline.quality(spark, twice, folder).count() == 2 * corpus_pipeline.quality(spark, docs, folder).count()
    once, again = (corpus_pipeline.near_copies(spark, d, folder).collect() for d in (docs, cut(twice, "twice")))
    assert Counter(map(tuple, once)) == Counter(map(tuple, again))
    assert corpus_pipeline.mixture(spark, cut(twice, "twice"), folder).count() == twice.count()


def test_stages_on_an_empty_table(spark, data):
    folder, _ = data
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS).collect()]


def query(spark, folder, name):
    return Counter(map(tuple, QUERIES[name](spark, folder).collect()))


def test_suffix_dedup_query(spark, folder, corpus):
    assert query(spark, folder, "op4_suffix_dedup") == brute.bytes_removed(corpus)


def test_simhash_query(spark, folder, corpus):
    prints = [brute.fingerprint(r[1]) for r in corpus]
    roots = brute.components(prints)
    least = {}
    for r, root in zip(corpus, roots):
        least[root] = min(least.get(root, r[0]), r[0])
    assert query(spark, folder, "op6_simhash") == Counter((r[0], f"{p:016x}", least[root]) for r, p, root in zip(corpus, prints, roots))


def plain_spans(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(s))) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(found)


def test_pii_query(spark, folder, corpus):
    kinds = ["email", "ip", "card", "phone"]
    got = {r.doc_id: r for r in QUERIES["op8_pii"](spark, folder).collect()}
    for doc_id, text, *_ in corpus:
        spans, r = plain_spans(text or ""), got[doc_id]
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in spans) for k in range(4)]
        assert r.base_sha256 == brute.sha(",".join(listed)) and set(listed) <= set(filter(None, r.spans.split(",") + [None]))


def test_language_query(spark, folder, corpus):
    rows = QUERIES["op5_language_id"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in corpus)


def test_stages_with_clashing_columns(spark, data):
    folder, _ = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["n_words", "_text", "_words", "_lines", "fail_bits", "key", "component", "page", "n", "total", "SIZE", "taken", "target", "source_size", "_taken", "_own",
             "n_hit", "contaminated", "digest", "cell"]
    wide, plain = docs, docs
    for k, name in enumerate(names):
        wide = wide.withColumn(name, F.lit(k))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide, plain = (cut(stage(spark, d, folder), "clash") for d in (wide, plain))
        assert wide.columns == COLUMNS + names
        assert Counter(map(tuple, wide.select(*COLUMNS).collect())) == Counter(map(tuple, plain.collect()))
    mixed = cut(corpus_pipeline.mixture(spark, wide, folder), "clash")
    assert mixed.columns == COLUMNS + [n for n in names if n.lower() not in corpus_pipeline.MIXED] + corpus_pipeline.MIXED
    assert mixed.count() == wide.count() and mixed.where("size > 0 and taken > 0").count() > 0
