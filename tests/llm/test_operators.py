"""Each corpus operator against its plain version, over odd rows, and on empty tables."""

import random
import re
import textwrap
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import (components, decontaminate, language_id, license_scan, line_dedup, mixing, pii_crf, quality_rules, simhash, substring_dedup,
                           suffix_array, suffix_dedup)
from callweave.llm.license_texts import BSD_END, BSD_START, MIT


@pytest.fixture(scope="module")
def table():
    return brute.rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    return brute.frame(spark, table).repartition(5)


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_substring_dedup(docs, table):
    got = substring_dedup.deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert found(got) == brute.windows_removed(table)


@pytest.mark.parametrize("length", [31, 64])
def test_substring_dedup_other_lengths(docs, table, length):
    got = substring_dedup.deduplicated(docs, length).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert found(got) == brute.windows_removed(table, length)


def test_cover_holds_every_difference():
    p = substring_dedup.PERIOD
    assert {(a - b) % p for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(p))


def test_suffix_dedup(docs, table):
    got = suffix_dedup.deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert found(got) == brute.bytes_removed(table)


def test_suffix_dedup_with_hot_grams(docs, table, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    got = suffix_dedup.deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert found(got) == brute.bytes_removed(table)


@pytest.mark.parametrize("widest", [1024, 3])
def test_suffix_array(monkeypatch, widest):
    monkeypatch.setattr(suffix_array, "WIDEST", widest)
    rng = np.random.default_rng(widest)
    for _ in range(300):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)), 0)
        order = suffix_array.suffix_array(text, 6)
        plain = sorted(range(len(text)), key=lambda i: tuple(text[i:]))
        assert order.tolist() == plain
        prefix, phi = suffix_array.common_prefixes(text, order)
        for a, b in zip(plain, plain[1:]):
            n = next(k for k in range(len(text)) if text[a + k] != text[b + k])
            assert phi[b] == a and prefix[b] == n


def test_decontamination(spark, docs, table):
    items = brute.items()
    got = decontaminate.verdicts(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == brute.contamination(table, items)


def test_decontamination_in_small_blocks(spark, docs, table, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 7)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 5)
    items = brute.items()
    got = decontaminate.verdicts(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == brute.contamination(table, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b c"), (2, "a b c"), (3, "a x y b c"), (4, "c b a")], "doc_id long, text string")
    item = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    near = decontaminate.marked(docs, item, slop=1)
    assert {r.doc_id for r in near.collect() if r["items"]} == {1, 2}
    docs = spark.createDataFrame([(1, "z a x b c z"), (3, "a x y b c z")], "doc_id long, text string")
    near = decontaminate.marked(docs, item, slop=1)
    assert {r.doc_id for r in near.collect() if r["items"]} == {1}


def test_simhash(docs, table):
    prints = [brute.fingerprint(r[1]) for r in table]
    roots = brute.components(prints)
    least = {}
    for r, root in zip(table, roots):
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    got = simhash.grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert found(got) == Counter((r[0], f"{p:016x}", least[root]) for r, p, root in zip(table, prints, roots))


@pytest.mark.parametrize("crowded", [256, 2])
def test_near_links(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(crowded)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(rng.randint(0, 8)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    roots = brute.components(prints)
    cells = np.zeros(len(prints), dtype=np.int64)
    a, b = simhash.links_in_cells(cells, np.array(prints, dtype=np.uint64))
    local = {int(x): int(y) for x, y in zip(a, b)}
    assert len(set(roots)) == len(prints) - len(local)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r.node: r.root for r in components.components(links).collect()}
    groups, wanted = {}, {}
    for p, s, r in zip(prints, signed, roots):
        groups.setdefault(got.get(s, s), set()).add(s)
        wanted.setdefault(r, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("id * 7 % 307 as a", "(id + 1) * 7 % 307 as b")
    got = components.components(links).collect()
    assert len(got) == 300 and {r.root for r in got} == {0}


def test_quality_rules(docs, table):
    book = quality_rules.ledger(docs)
    got = book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      ~quality_rules.passes(F.col("fail_bits"), 1), quality_rules.passes(F.col("fail_bits"), 3))
    assert found(got) == brute.quality(table)
    rows = book.collect()
    for r in quality_rules.ablation(book, 3).collect():
        bit = quality_rules.mask([r.rule])
        assert r.n_failed == sum(1 for x in rows if x.fail_bits & bit) and r.n_only == sum(1 for x in rows if x.fail_bits == bit)


def test_line_dedup(docs, table):
    got = line_dedup.cleaned(docs, "source", "text")
    assert got.columns == docs.columns
    assert found(got.select("doc_id", "text", "lang", "source", "n_chars")) == Counter(brute.without_boilerplate(table))


def test_line_dedup_drops_and_keeps(spark):
    pages = [("a", "menu\nown %d\nmenu \n" % k) for k in range(40)] + [("b", "menu\nx")] * 2 + [(None, "menu")] * 3
    got = line_dedup.line_counts(spark.createDataFrame(pages, "host string, text string"), "host", "text")
    kept = Counter((r.host, r.text.split("\n")[0] if r.text else r.text, r.n_lines, r.n_removed) for r in got.collect())
    assert kept[("b", "menu", 2, 0)] == 2 and kept[(None, "", 1, 1)] == 3 and sum(n for k, n in kept.items() if k[0] == "a" and k[3] == 2) == 40


def test_hosts_and_visible_lines(spark):
    row = spark.sql("select 'HTTPS://u:p@Ab.example.org:80/x' as a, 'nothing' as b, '<html><script>x<p></script><p>A<b>b</b> c</p><!-- <p> --><div>d\ne</div>' as h")
    got = row.select(line_dedup.host(F.col("a")).alias("a"), line_dedup.host(F.col("b")).alias("b"), line_dedup.visible_lines(F.col("h")).alias("h")).first()
    assert got.a == "ab.example.org" and got.b is None and got.h.split("\n") == ["", "Ab c", "d e", ""]


def plain_visible(html):
    text = re.sub(r"<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<!doctype[^>]*>", "", html, flags=re.I | re.S)
    text = re.sub(r"[\n\r]+", " ", text)
    text = re.sub(r"</?(p|div|li|ul|ol|nav|header|footer|article|section|h[1-6]|br|tr|table|title|body|head|html)\b[^>]*>", "\n", text, flags=re.I)
    return re.sub(r" *\n[ \n]*", "\n", re.sub(r"<[^>]*>", "", text))


def test_visible_lines_of_broken_pages(spark):
    rng = random.Random(8)
    bits = ["<script>", "</script >", "<STYLE x", "</style>", "<!--", "-->", "<!doctype", ">", "<", "<p>", "</div>", "<b", " ", "\n", "a", "é", "- ", "<!-->", "br"]
    pages = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(3000)] + [(-1, None), (-2, "")]
    frame = spark.createDataFrame(pages, "k long, html string").select("k", line_dedup.visible_lines(F.col("html")).alias("text"))
    assert {r.k: r.text for r in frame.collect()} == {k: None if html is None else plain_visible(html) for k, html in pages}


def test_pages_with_few_and_many_openings_agree_with_the_plain_form(spark):
    rng = random.Random(9)
    bits = ["<script>", "</script>", "<STYLE x", "<!--", "-->", "<!doctype", ">", "<", "<p>", "<b", "  ", "\n", "\r\n", " \n ", "a"]
    pages = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(60, 260)))) for k in range(600)]
    pages += [(-n, "<p>a </p>" * 3 + bit * n + tail) for n in (31, 32, 33, 40) for bit, tail in (("<!-- ", "x"), ("<script>", " \n</script>b"), ("<", " "), ("<p", "\n"))]
    frame = spark.createDataFrame(pages, "k long, html string").select("html", line_dedup.visible_lines(F.col("html")).alias("text"))
    assert {r.html: r.text for r in frame.collect()} == {html: plain_visible(html) for _, html in pages}


def test_ordinary_pages_cost_less_than_the_plain_replacements(spark):
    page = "<!DOCTYPE html><html><head><style>p{}</style><script>x</script></head><body><!-- ad -->" + "<p>Some <b>words</b> of a page, and more of them.</p>" * 80 + "</body></html>"
    pages = spark.range(6000).repartition(8).select(F.concat(F.lit(page), F.col("id").cast("string")).alias("html"))
    plain = F.col("html")
    for pattern, by in ((r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<!doctype[^>]*>", ""), (r"[\n\r]+", " "),
                        (r"(?i)</?(p|div|li|ul|ol|nav|header|footer|article|section|h[1-6]|br|tr|table|title|body|head|html)\b[^>]*>", "\n"),
                        (r"<[^>]*>", ""), (r"(?<! ) *\n[ \n]*", "\n")):
        plain = F.regexp_replace(plain, pattern, by)

    def seconds(text):
        took = []
        for _ in range(4):
            start = time.monotonic()
            pages.select(text.alias("text")).write.format("noop").mode("overwrite").save()
            took.append(time.monotonic() - start)
        return min(took)

    assert seconds(line_dedup.visible_lines(F.col("html"))) < seconds(plain)


@pytest.mark.parametrize("bit", ["<", "<script>", "<!--", "<!doctype ", "<p ", "<style", " ", "<!-->", "</script", "<script>-->"])
def test_pages_of_openings_take_linear_time(spark, bit):
    n = 400_000 // len(bit)
    rows = spark.range(1).select(F.concat(F.lit("x"), F.repeat(F.lit(bit), F.lit(n)), F.lit("y")).alias("html"))
    start = time.monotonic()
    text = rows.select(line_dedup.visible_lines(F.col("html")).alias("text")).first().text
    assert time.monotonic() - start < 20 and text[0] == "x" and text[-1] == "y"


def test_license_scan(spark):
    texts = [(1, MIT), (2, "Copyright (c) 2020 A B\n\n" + MIT.upper().replace(",", " ;")), (3, MIT + " extra"), (4, f"{BSD_START}\n\n{BSD_END}"),
             (5, "prose\nReleased under the MIT Licence.\nlicensed under CC BY-NC 4.0\nMIT"), (6, None), (7, ""), (None, "(c) me")]
    got = {r.doc_id: (r.license, r.notices, r.n_notices) for r in license_scan.scanned(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "", 0), 2: ("MIT", "", 0), 3: (None, "", 0), 4: ("BSD-2-Clause", "", 0), 5: (None, "CC-BY-NC-4.0,MIT", 3), 6: (None, "", 0),
                   7: (None, "", 0), None: (None, "", 0)}


def test_mixing(docs, table):
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(table)
    total = sum(r["size"] for r in rows)
    sources, taken = {}, Counter()
    for r in rows:
        sources[r.source] = (r.source_size, r.target)
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"]
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    capped = {}
    while True:  # share by weight, cap, share the rest again
        left = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sources[s][0]]
        if not over:
            break
        capped |= {s: 3 * sources[s][0] for s in over}
    for s in order:
        assert sources[s][1] == pytest.approx(capped.get(s, share.get(s)))
        assert abs(taken[s] - sources[s][1]) <= max(8, 0.01 * sources[s][1])
    assert found(mixing.taken(docs)) == Counter(tuple(r) for r in rows)


def test_schedule_is_even(spark, docs):
    _, pieces = mixing.mix(docs)
    rows = sorted((r.slot, r.source, r["rank"]) for r in pieces.select("slot", "source", "rank").distinct().collect())
    seen = Counter()
    for _, source, rank in rows:
        assert rank == seen[source]  # blocks are taken in order
        seen[source] += 1
    half = Counter(source for slot, source, _ in rows if slot < len(rows) // 2)
    assert all(abs(half[s] - seen[s] / 2) <= 12 for s in seen)


def test_pii(docs, table):
    rows = pii_crf.scanned(docs).collect()
    text = next(t for _, t, *_ in table if t and t.startswith("write a.b@"))
    k = next(r[0] for r in table if r[1] == text)
    base = next(r.base for r in rows if r.doc_id == k)
    assert [text[s.start: s.end] for s in base] == ["a.b@c.example.org", "+1 (555) 123-4567", "10.0.0.1", "4111 1111 1111 1111"]
    assert len(rows) == len(table) and all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in rows)
    assert all(not r.spans for r in rows if r.doc_id in (900, 901, 902, 903))
    masked = {r.doc_id: r.text for r in pii_crf.redacted(docs).collect()}
    assert masked[k].startswith("write [email] or [phone], [ip] and [card], ") and masked[900] is None


def test_pii_field_learns_from_labels():
    rng = random.Random(3)
    texts = [f"see {rng.randint(10**15, 10**16 - 1)} or x{k}@mail.example.org now" for k in range(60)] + [f"in {1900 + k} of" for k in range(60)] + [f"token = \"{rng.getrandbits(160):040x}\" is it" for k in range(60)]
    weights = pii_crf.fit(texts)
    text = 'take 1234567890123456 and "token = "' + "0123456789abcdef" * 2 + 'aa" in 2024'
    spans = {(pii_crf.KINDS[k], text[a:b]) for a, k, b in pii_crf.spans_of(text, weights)[1]}
    assert ("card", "1234567890123456") in spans and any(k == "secret" for k, _ in spans) and not any("2024" in s for _, s in spans)


def test_pii_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(7)
    weights = rng.normal(size=(len(pii_crf.KINDS), len(pii_crf.FEATURES)))
    text = " ".join(rng.choice(["12", "a@b.c", "+1 (2) 3", "x", "9.9.9.9", "tok = \"7f\""], 60))
    whole = pii_crf.best_spans(text, 0, len(text), weights)
    monkeypatch.setattr(pii_crf, "BLOCK_TOKENS", 3)
    assert whole and pii_crf.best_spans(text, 0, len(text), weights) == whole


def test_pii_patterns_are_linear_and_leftmost():
    big = "a" * 200_000 + "1" * 200_000 + "." * 1000 + "@" * 1000
    assert pii_crf.base_spans(big) == []
    assert pii_crf.emails("a@b.c@d.e x@y z%1@q-r.st.u.") == [(0, 5), (14, 26)]
    assert [s for s in pii_crf.base_spans("1.2.3.4.5.6.7.8 256.1.1.1")] == [(0, 1, 7), (8, 1, 15)]


def test_language_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_id_odd_rows(docs, table):
    rows = language_id.identified(docs).collect()
    assert len(rows) == len(table)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (900, 901)) and {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    blank = language_id.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in blank} == {"und"}


def test_empty_tables(spark):
    none = brute.frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    for got in (substring_dedup.deduplicated(none), suffix_dedup.deduplicated(none), decontaminate.verdicts(none, items), simhash.grouped(none), mixing.taken(none),
                quality_rules.ledger(none), line_dedup.cleaned(none, "source", "text"), license_scan.scanned(none), pii_crf.scanned(none), language_id.identified(none)):
        assert got.collect() == []
    some = brute.frame(spark, brute.rows()[:3])
    assert {r.n_items for r in decontaminate.verdicts(some, items).collect()} == {0}


def test_languages_with_few_ids_are_learned(spark):
    open_ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(open_ids[0], f"the cat and the dog {k}", "en") for k in range(2000)] + [(open_ids[1], f"le chat et le chien {k}", "fr") for k in range(2000)]
    rows += [(open_ids[2], "der hund und die katze", "de")] * 3000
    picked = language_id.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = Counter(r.lang for r in picked.collect())
    assert set(found) == {"en", "fr", "de"} and max(found.values()) <= language_id.ROWS_PER_LANGUAGE and min(found.values()) > 200


@pytest.mark.parametrize("width", range(40, 110, 7))
def test_wrapped_licences_are_known(spark, width):
    texts = ["\n\n".join(textwrap.fill(part, width) for part in text.split("\n\n")) for text in (MIT, BSD_START + " " + BSD_END)]
    whole = [MIT, BSD_START + " " + BSD_END]
    df = spark.createDataFrame(list(enumerate(texts + whole)), "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", license_scan.canonical(F.col("text")).alias("c")).collect()}
    assert got[0] == got[2] and got[1] == got[3]
