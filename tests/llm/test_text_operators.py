"""The text operators against brute force, round trips and the cases that tables may hold."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harness import compare, duck
from txnlens.llm import fingerprints, license_scan, mixture, near_dedup, packing, quality_classifier, quality_rules
from txnlens.llm import queries, substring_dedup, textual, toxicity, warc
from txnlens.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, h string, size int"
WORD = re.compile("[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 700}x{i % 11}" for i in range(4000))
COPY = " ".join(f"copy{i}" for i in range(60))
ODD = [  # nulls in any column, empty and long texts, ties, repeated rows, clashing names
    (1, COPY, "en", "a", 3, 0.5, "x", 1), (2, COPY, None, "b", None, None, None, None), (2, COPY, None, "b", None, None, None, None),
    (3, None, "en", None, 0, 1.0, "y", 2), (4, "", "en", "a", 0, 1.0, "y", 2), (None, COPY + " end", "en", "a", 1, 1.0, "z", 3),
    (None, None, None, None, None, None, None, None), (5, LONG, "en", "b", 1, 0.0, "", 0), (6, " \n\t ", "en", "a", 1, 0.0, "", 0),
    (7, "one two three", "en", "c", 1, 0.0, "", 0), (8, "ONE Two three", "en", "c", 1, 0.0, "", 0), (9, "é" * 9, "fr", "a", 9, 0.0, "", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    queries.ship(spark)
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def documents(spark):
    queries.ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF).sql(queries.ORACLES[name])) is None


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


# --- quality rules -----------------------------------------------------------
def base_counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_counts_equal_brute_force(spark, documents, odd):
    for docs in (documents, odd):
        got = Counter((r["doc_id"], *[r[c] for c in quality_rules.COUNTS]) for r in quality_rules.measures(docs).collect())
        assert got == Counter((r["doc_id"], *base_counts(r["text"])) for r in docs.select("doc_id", "text").collect())


def test_rules_reject_junk_and_keep_the_rest(spark):
    queries.ship(spark)
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.apply_rules(documents, labels).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    assert rows and all(r["kept"] == (r["quality"] == 1) for r in rows)


def test_rules_grow_conjunctions_and_order_them(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, symbols_per_word double, upper_share double")
    frame = frame.withColumn("bad", F.expr("symbols_per_word > 6 AND upper_share > 3")).withColumn("prune", F.col("doc_id") % 3 == 0)
    frame = frame.selectExpr("bad", "prune", *[n if n in frame.columns else f"0.0D AS {n}" for n in quality_rules.RATIOS])
    rules = quality_rules.learn_rules(frame)
    got = frame.select("bad", quality_rules.verdict(rules).isNotNull().alias("hit")).collect()
    assert rules and all(r["bad"] == r["hit"] for r in got)


def test_rules_without_labels_keep_all_that_pass(documents, labels, odd):
    out = quality_rules.apply_rules(odd, labels.limit(0)).collect()
    assert len(out) == len(ODD) and all(r["kept"] != r["base_failed"] for r in out)


# --- mixing ------------------------------------------------------------------
def brute_mix(rows):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total, own = sum(size), {n: sum(z for z, r in zip(size, rows) if r[2] == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, open_ = {}, set(names)
    rest = 1.5 * total
    while open_:
        share = rest / sum(weight[n] for n in open_)
        full = {n for n in open_ if 2 * own[n] < share * weight[n]}
        for n in full or open_:
            target[n] = 2.0 * own[n] if full else share * weight[n]
        if not full:
            break
        rest -= sum(target[n] for n in full)
        open_ -= full
    return own, target


def test_mix_of_odd_rows(odd, none):
    got = mixture.mix(odd).collect()
    own, target = brute_mix([(r[0], r[1], r[3]) for r in ODD])
    assert len(got) == len(ODD)
    assert sorted((r["source_size"], round(r["target"], 6)) for r in got) == sorted(
        (own[r[3]], round(target[r[3]], 6)) for r in ODD)
    assert all(r["taken"] <= 2 * r["size"] for r in got) and mixture.mix(none).count() == 0


def test_mixed_documents_hold_the_words_taken(documents):
    taken = {r["doc_id"]: r["copies"] for r in mixture.mix(documents).collect()}
    got = Counter(r["doc_id"] for r in mixture.mixed_documents(documents).collect())
    assert got == Counter({k: v for k, v in taken.items() if v})


# --- near duplicates -----------------------------------------------------------
def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 501 + i) for i in range(50)] + [(900 + i, 900 + (i + 1) % 9) for i in range(9)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {a: b for lo, hi in ((100, 141), (500, 551), (900, 909)) for a, b in ((x, lo) for x in range(lo, hi))}


def brute_groups(rows, percent=85):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return Counter((rows[i][0], len(sets[i]), least[group[i]] if sets[i] else rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [2, 512])
def test_near_duplicates_equal_brute_force(spark, odd, none, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = near_dedup.near_duplicates(odd).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups([(r[0], r[1]) for r in ODD])
    # a group of copies with a growing number of edits: links between neighbours and not to the first
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = words[:3 * i] + [f"new{i}"] + words[3 * i + 1:]
        rows.append((i, " ".join(words[:120])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows)
    assert near_dedup.near_duplicates(none).count() == 0


def test_members_of_the_largest_part_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "_compare", lambda percent: lambda members: members.assign(u=len(members), v=0)[["u", "v"]].head(1))
    stars = spark.createDataFrame([(0, i) for i in range(1, 41)], "u bigint, v bigint")
    parts_ = spark.createDataFrame([(i, 0) for i in range(40)], "node bigint, component bigint")
    signed = spark.createDataFrame([(i, [i]) for i in range(41)], "node bigint, signature array<bigint>")
    met = near_dedup._other_links(stars, parts_, signed, signed.withColumnRenamed("signature", "shingles"), 85)
    assert sum(r["u"] for r in met.collect()) == 40 + 21  # 861 if every two blocks meet


# --- passages ----------------------------------------------------------------
def brute_passages(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        cut = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for k in range(window)}
        out.append((doc_id, len(w), len(cut), " ".join(x for i, x in enumerate(w) if i not in cut)))
    return Counter(out)


@pytest.mark.parametrize("hot", [1, 3, 5000])
def test_passages_equal_brute_force(spark, odd, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = np.random.default_rng(3)
    base = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], 40).tolist() + base + ["the"] * int(rng.integers(0, 30)))) for i in range(30)]
    for docs, window in ((odd, 35), (spark.createDataFrame(rows, "doc_id bigint, text string"), 10)):
        got = substring_dedup.remove_repeats(docs, window, 8 if window == 35 else 3).select("doc.doc_id", "n_words", "n_removed", "kept")
        assert Counter(map(tuple, got.collect())) == brute_passages(docs.select("doc_id", "text").collect(), window)
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("share", [2, 20])
def test_hot_super_kmers_that_meet_an_equal_one_are_passed_once(spark, monkeypatch, share):
    monkeypatch.setattr(substring_dedup, "HOT", 5)
    monkeypatch.setattr(substring_dedup, "SHARE", share)
    passed, hot_ranges = [], substring_dedup._hot_ranges
    monkeypatch.setattr(substring_dedup, "_hot_ranges", lambda hot, window: passed.append(hot) or hot_ranges(hot, window))
    base = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([f"a{i}", *base[:40 - i % 7 * (i < 20)], f"b{i}"])) for i in range(200)]
    rows += [(300 + i, " ".join(base[5:30] + [f"c{i % 3}"] + base)) for i in range(30)] + [(None, " ".join(base))] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.remove_repeats(docs, 10, 3).select("doc.doc_id", "n_words", "n_removed", "kept")
    assert Counter(map(tuple, got.collect())) == brute_passages(rows, 10)
    n = [r["n"] for r in passed[0].select("n").collect()]
    assert sum(n) > 1000 and len(n) < (0.8 if share == 2 else 0.3) * sum(n)


def test_passage_steps_hold_a_part_of_a_batch_as_objects():
    """Of 10,000 texts of 3,400 bytes with 20 ranges each, no step holds all texts or a Python object per range."""
    n, k = 10_000, 20
    text = " ".join(f"word{i:04}" for i in range(378)).encode()
    first = np.tile(np.arange(k, dtype=np.int32) * 17, n)
    offsets = np.arange(n + 1, dtype=np.int32) * k
    ids, keys = pa.array(np.arange(n)), pa.array(np.arange(n) * 7)
    found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([first, first + np.int32(45)], ["first", "last"]))
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
        [first.astype(np.int64), first, np.full(n * k, 11, np.int32), np.zeros(n * k, np.int64)], ["minimiser", "first", "size", "shares"]))
    texts = pa.RecordBatch.from_pydict({"doc_id": ids, "text_key": keys, "text": pa.array([text] * n, pa.binary()), "runs": runs})
    ranges = pa.RecordBatch.from_pydict({"id": ids, "key": keys, "found": found})
    for step, batch, rows in ((substring_dedup._minimisers(35, 8), texts, None), (substring_dedup._places(35, 8), texts, None),
                              (substring_dedup._pack(35), texts, n * k), (substring_dedup._merged, ranges, n)):
        tracemalloc.start()
        made = sum(len(b) for b in step(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 34e6 and made == (rows or made) > 0


# --- packing -------------------------------------------------------------------
def test_pieces_are_the_tokenizers(documents, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    extra = odd.sparkSession.createDataFrame([(77, "<|ENDOFTEXT|> A<|endoftext|>b don't É́x\x1cy…. 12"), (78, "İΣΑΣ ﬁ")], "doc_id bigint, text string")
    for docs in (documents, odd, extra):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
            for s in range(0, len(ids), 2048):
                want[r["doc_id"], s // 2048, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())] += 1
        assert Counter(map(tuple, packing.token_pieces(docs, TOKENIZER).collect())) == want


def test_packing_is_gapless_and_tight(documents, none):
    rows = packing.pack_documents(documents, TOKENIZER).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_best_two_fit_swaps_the_shortest_for_two():
    bins, offsets = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)  # 6 + 3 leaves 1; 6 + 2 + 2 leaves none
    assert len(set(bins)) == 2 and bins[0] == bins[2] == bins[3] and sorted(offsets[[0, 2, 3]]) == [0, 6, 8]
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 50, 2000)
    bins, _ = packing.best_two_fit(lengths, 50)
    assert np.bincount(bins, lengths).max() <= 50 and len(set(bins)) <= math.ceil(lengths.sum() / 50) * 1.01


# --- archives -------------------------------------------------------------------
def test_archives_round_trip(spark):
    big = "<p>" + "x" * 3000
    rows = [(1, "http://a/ b\r\nc", big), (2, None, big), (3, "http://c", big), (3, "http://c", big), (4, "u", None), (5, "u", ""), (6, "u", "é" * 400),
            (7, "u", "é" * 400), (None, "u", big), (8, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "y" * 3_000_000)]
    queries.ship(spark)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    index, folder = warc.archive_pages(pages)
    got = warc.read_archives(index, folder).collect()
    refers = {1: 3, 2: 3, None: 3, 8: 9}
    want = Counter()
    for page, _, html in rows:
        payload = (html or "").encode()
        want[page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if page in refers else "response", refers.get(page), b"" if page in refers else payload] += 1
    assert Counter((*tuple(r)[:5], bytes(r["payload"])) for r in got) == want
    for row in index.collect():
        fields, payload = warc.fetch(row, folder)
        assert fields["WARC-Record-ID"] == row["record_id"] and (fields["WARC-Type"] == "revisit" or len(payload) == int(fields["WARC-Payload-Length"]))
    index, folder = warc.archive_pages(pages.limit(0))
    assert warc.read_archives(index, folder).count() == 0


# --- fingerprints ----------------------------------------------------------------
def test_fingerprints_of_texts_and_edits(spark, documents, odd, none):
    for docs in (documents, odd):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
        texts = [r[1] or "" for r in rows]
        edits = [a[:len(a) - len(a) // 2] + b[:len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1])]
        got = fingerprints.fingerprint_neighbours(docs).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(
            (r[0], len(t), hashlib.sha256(e.encode()).hexdigest()) for r, t, e in zip(rows, texts, edits))
        prints = {e: fingerprints.digests([e.encode()])[0].tobytes().hex() for e in {*edits, *texts}}
        assert Counter((r["fingerprint"], r["edited_fingerprint"]) for r in got) == Counter((prints[t], prints[e]) for t, e in zip(texts, edits))
        assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprints.fingerprint_neighbours(none).count() == 0
    same = fingerprints.digests([b"abc" * 50, b"abc" * 50])
    assert fingerprints.likeness(same[:1], same[1:])[0] == 1
    opposite = np.zeros((2, 3 + fingerprints.BUCKETS // 4), np.uint8)
    opposite[1] = 255
    opposite[1, 1:3] = 15
    assert fingerprints.likeness(opposite[:1], opposite[1:])[0] == 0


# --- learnt scores -----------------------------------------------------------------
@pytest.mark.parametrize("operator, label", [(quality_classifier.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_scores_on_held_out_rows_and_odd_tables(spark, odd, none, labels, operator, label):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = operator(docs, known).join(known, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    good, bad = [r["score"] for r in held if r[label]], [r["score"] for r in held if not r[label]]
    assert np.mean([a > b for a in good for b in bad]) > 0.75 and np.mean([r["predicted"] == r[label] for r in held]) > 0.9
    for some in (labels, labels.limit(0)):
        got = operator(odd, some).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert operator(none, labels).count() == 0


def test_label_model_finds_accuracies_and_a_copied_voter():
    rng = np.random.default_rng(5)
    y = rng.random(200_000) < 0.2
    yes, no = np.array([0.7, 0.6, 0.5, 0.8, 0.4, 0.1, 0.1]), np.array([0.05, 0.1, 0.02, 0.1, 0.05, 0.9, 0.8])
    votes = np.where(y[:, None], rng.random((len(y), 7)) < yes, rng.random((len(y), 7)) < no)
    votes[:, 1] = np.where(rng.random(len(y)) < 0.9, votes[:, 0], votes[:, 1])  # a copy of the first
    v = votes.astype(float)
    model = toxicity.fit_label_model(len(y), v.sum(axis=0), v.T @ v, 0.2)
    keep = [0, 2, 3, 4, 5, 6]
    assert np.abs(model.if_toxic - yes)[keep].max() < 0.08 and model.correlated[0, 1] > 0.2
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.93


# --- licenses ------------------------------------------------------------------------
def test_licenses_with_other_case_noise_and_odd_tables(spark, odd, none):
    notice = license_scan.TEMPLATES["GPL-3.0"]
    filler = " ".join(f"q{i}" for i in range(37))
    rows = [(i, f"{' '.join(f'z{k}' for k in range(i))} {notice.upper() if i % 2 else notice} {filler}") for i in range(40)]
    rows.append((99, notice.replace("General", "Lesser") + filler))
    got = license_scan.license_matches(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["license"] == "GPL-3.0" and r["containment"] == 1) == list(range(40))
    assert license_scan.license_matches(odd).count() == 0 and license_scan.license_matches(none).count() == 0
    assert license_scan.miss_probability(5) < 1e-14 and max(map(license_scan.miss_probability, range(5, 400))) < 1e-5


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so{}. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
CONDITION = """, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software"""
GNU_NOTICE = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License
as published by the Free Software Foundation; {}version {} of the License. This program is distributed WITHOUT ANY WARRANTY."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that {} other
materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"""
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse products. "
ADVERTISE = "All advertising materials mentioning features or use of this software must display the following acknowledgement: this. "


def test_licenses_by_text_and_phrase_with_versions_apart(spark):
    texts = {
        "Licensed under the MIT License.": "MIT", "released under MIT license": "MIT", "MIT License\n\nCopyright (c) 2020 A": "MIT",
        MIT_TEXT.format(CONDITION): "MIT", MIT_TEXT.format(""): "MIT-0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "Apache License, Version 2.0": "Apache-2.0", "GPLv3 or later": "GPL-3.0",
        BSD_TEXT.format("the", ""): "BSD BSD-2-Clause", BSD_TEXT.format("the", "3. " + ENDORSE): "BSD BSD-3-Clause",
        BSD_TEXT.format("the", f"3. {ADVERTISE}4. {ENDORSE}"): "BSD BSD-4-Clause",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.": "ISC",
    }
    for kind, version, name in (("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")):
        texts |= {GNU_NOTICE.format(kind, w, version): name for w in ("either ", "")}
        texts[f"This work is licensed under the GNU {kind}General Public License, version {version}."] = name
    rows = [(100 * k + before, " ".join(f"z{i}" for i in range(before)) + " " + text) for k, text in enumerate(texts) for before in (0, 7, 30)]
    found = {}
    for r in license_scan.license_matches(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"].split("/")[0])
    assert {i: found.get(i, set()) for i, _ in rows} == {100 * k + b: set(v.split()) for k, v in enumerate(texts.values()) for b in (0, 7, 30)}
    assert max(license_scan.miss_probability(len(license_scan.template_words(t))) for t in license_scan.TEMPLATES.values()) < 1e-5


# --- pipeline -------------------------------------------------------------------------
def test_pipeline_equals_brute_force(spark, documents, labels):
    docs, stages = documents, dict(corpus_pipeline.STAGES)
    verdicts = {r["doc_id"] for r in quality_rules.apply_rules(docs, labels).where("kept").collect()}
    docs = corpus_pipeline.stored(stages["quality_rules"](spark, docs, SF), "t")
    assert {r["doc_id"] for r in docs.collect()} == verdicts
    rows = docs.select("doc_id", "text").collect()
    keep = {i for i, _, c in brute_groups(rows) if i == c}
    docs = corpus_pipeline.stored(stages["minhash_dedup"](spark, docs, SF), "t")
    assert docs.columns == documents.columns and {r["doc_id"] for r in docs.collect()} == keep
    want = Counter((i, kept if cut else None) for i, _, cut, kept in brute_passages(docs.select("doc_id", "text").collect(), 35))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs = corpus_pipeline.stored(stages["substring_dedup"](spark, docs, SF), "t")
    assert Counter((r["doc_id"], None if r["text"] == before[r["doc_id"]] else r["text"]) for r in docs.collect()) == want
    size = sum(len(WORD.findall(r["text"])) for r in docs.collect())
    mixed = corpus_pipeline.stored(stages["mix_sources"](spark, docs, SF), "t")
    assert abs(sum(len(WORD.findall(r["text"])) for r in mixed.collect()) - 1.5 * size) < 0.2 * size
    assert mixed.columns == documents.columns
    last = stages["best_two_fit"](spark, mixed, SF)
    assert last.where("piece = 0").count() == mixed.count()


def test_pipeline_stages_take_odd_tables(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns, name
            stage(spark, docs, SF).collect()


# --- hashing ----------------------------------------------------------------------------
def test_words_and_grams_do_not_depend_on_their_place():
    w = textual.Words([b"a b c", b"", b" b c\ta b c ", "é x".encode()])
    assert w.counts.tolist() == [3, 0, 5, 2] and w.hash[1] == w.hash[3] == w.hash[6]
    at, h = w.grams(2)
    assert at.tolist() == [0, 1, 3, 4, 5, 6, 8] and h[1] == h[2] == h[5] and len(set(h.tolist())) == 4
    assert textual.Words([b"A b"], lower=True).hash[0] == textual.Words([b"a"]).hash[0]




def test_a_coder_that_forgets_words_gives_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    coder = packing.Coder(TOKENIZER)
    sizes = []
    for i in range(60):
        texts = [f"Often seen, again! word{i} other{i * 7}; (x{i})", "", "don't <|endoftext|> stop.", f"{i} naïve, é! often"]
        want = [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert [x.tolist() for x in coder.ids([t.encode() for t in texts], 0)] == want
        sizes.append(len(coder))
    assert max(sizes) <= 60 and any(b < a for a, b in zip(sizes, sizes[1:])) and b"again!" in coder


@pytest.mark.parametrize("name, by_word", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_tokenizers_that_join_words_get_whole_texts(documents, name, by_word):
    coder = packing.Coder(public_tokenizers.path(name))
    assert coder.by_word == by_word
    texts = [r["text"] for r in documents.select("text").collect()][:60] + ["a!b!! c", "É! ×! ÷. ñ", "--- ... 12,5 x2!", "İstanbul! ǅ", " \n"]
    want = [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [x.tolist() for x in coder.ids([t.encode() for t in texts], 0)] == want


def test_bounds_hold_for_repeated_rows(spark, none):
    """One text per labelled id, a range once however often its row repeats, and no third copy of wordless rows."""
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id bigint, quality int")
    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('text ', id) AS text").unionByName(
        spark.createDataFrame([(2, "other")], "doc_id bigint, text string"))
    got = quality_classifier.labelled_sample(docs, labels, "quality", 10).collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(1, 1), (2, 0)]
    text = " ".join(f"w{i}" for i in range(400))
    rows = spark.createDataFrame([(7, text)] * 200, "doc_id bigint, text string").repartition(4)
    for r in substring_dedup.repeated_ranges(rows).collect():
        assert [(c["first"], c["last"]) for c in r["cut"]] == [(0, 400)]
    wordless = [(i, None if i % 2 else " ", "empty") for i in range(20)] + [(100, "one two", "full")] + [(200 + i, "word " * 50, "big") for i in range(4)]
    mixed = mixture.mixed_documents(spark.createDataFrame(wordless, "doc_id bigint, text string, source string"))
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
