"""The ten corpus operators: edge cases, round trips and brute force."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import licenses, mixing, near_duplicates, ogg, packing, quality_classifier, quality_rules, sharding, textkit, token_counts, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", None, "one", "a b", "A b  C\n\na b c\na b c", "x" * 5000, "word " * 3000, "é, à! “q” ？ 日本 語。", "tab\tand\x0bothers\x0c end\r\n", "  lead", "trail \n", "a b 　c", "don't <|endoftext|> stop <|endoftext|>", "a\x1cb", "same same same same same same"]


def docs(spark, texts, extra=False):
    rows = [(k, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else f"s{k % 3}", None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("size", "score", "rank", "copies", "target", "shard", "media", "kept", "n_words", "stats", "part", "rep", "n", "level"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def prose(n, seed=0, words=400, size=(30, 120)):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 9))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(*size))) for _ in range(n)]


# 1 quality rules


def test_rules_against_brute_force(spark):
    texts = TEXTS + prose(20) + ["a b c d\n" * 3 + "e", "# * $ %", "\n\n \n", "z\nz\nz \n"]
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs(spark, texts, True), ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_lines"]) == brute.measures(t), repr(t)
        assert bool(r["fail_bits"] & 1) == (r["n_words"] < 50)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab#é日", max_size=40), min_size=1, max_size=6))
def test_measures_on_any_text(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    got = np.stack(quality_rules.measure(np.frombuffer(b"".join(raw), np.uint8), offsets)[:6], axis=1)
    assert [tuple(map(int, row)) for row in got] == [brute.measures(t) for t in texts]


def test_ablation_counts(spark):
    entries = spark.createDataFrame([(b,) for b in [0, 0, 1, 3, 8, 9]], "fail_bits long")
    got = {r["name"]: (r["n_fail"], r["n_only"], r["kept_without"]) for r in quality_rules.ablations(entries, "full-1").collect()}
    assert got["few_words"] == (3, 1, 3) and got["symbols"] == (2, 1, 3) and got["upper_case"] == (0, 0, 2)
    assert entries.filter(quality_rules.passes("base-1")).count() == 3


# 2 packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_path())
    texts = TEXTS + prose(200) + ["Wörter, " * 6000, "<|startoftext|> A<|endoftext|>b", "<|ENDOFTEXT|>", "é. café, x…."]
    rows = packing.pack_documents(docs(spark, texts, True)).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(range(len(texts)))
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 4096)))
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == 4096 * r["piece"] and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"], repr(t)[:60]
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_sequences_hold_the_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_path())
    texts = TEXTS + prose(40) + ["again and again"] * 2
    table = docs(spark, texts)
    table = table.unionByName(table.filter("doc_id = 2"))
    parts = packing.pieces(table)
    placed = packing.pack_documents(table)
    found = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed, parts).collect()}
    rows = placed.collect()
    assert sum(map(len, found.values())) == sum(r["length"] for r in rows)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert found[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["start"] : r["start"] + r["length"]]


def test_equal_rows_are_dealt_to_all_groups(spark):
    df = spark.createDataFrame([(None, "some words")] * 3000, "doc_id long, text string").repartition(3)
    parts = packing.pieces(df, ids=False).cache()
    groups = Counter(r["sequence_id"] >> 32 for r in packing.pack(parts, 3000, group_rows=300).collect())
    assert len(groups) == 10 and max(groups.values()) < 500


def test_sum_of_squares_against_trying_every_bin():
    rng = np.random.default_rng(3)
    for size in (7, 20, 100):
        lengths = rng.integers(1, size + 1, 300)
        got, offset = packing.sum_of_squares(lengths, size)
        gaps: dict[int, int] = {}
        squares = lambda g: sum(n * n for n in Counter(x for x in g.values() if x).values())
        for k, s in enumerate(lengths.tolist()):
            tried = [squares({**gaps, b: gap - s}) for b, gap in gaps.items() if gap >= s] + [squares({**gaps, len(gaps): size - s})]
            b = int(got[k])
            assert offset[k] == size - gaps.get(b, size)
            gaps[b] = gaps.get(b, size) - s
            assert gaps[b] >= 0 and (s == size or squares(gaps) == min(tried))


def test_sum_of_squares_rule():
    where, offset = packing.sum_of_squares(np.array([6, 6, 4, 4, 3]), 10)
    assert where[0] != where[1] and sorted(where[2:4]) == sorted(where[:2]) and where[4] not in where[:4]
    assert packing.pack_documents


def test_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    assert packing.pack_documents(none).count() == 0
    assert quality_rules.ledger(none, ["doc_id"]).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert mixing.with_copies(none.select("doc_id", "source", mixing.word_count().alias("size"))).count() == 0
    assert ogg.decode(ogg.encode(none)).count() == 0
    assert near_duplicates.near_duplicates(none).count() == 0
    model = quality_classifier.fit(quality_classifier.document_statistics(none, ["doc_id"]), none.select("doc_id", F.lit(1).alias("quality")))
    assert quality_classifier.apply(model, quality_classifier.document_statistics(none, ["doc_id"])).count() == 0


# 3 sharding


def check_shards(rows, texts, shards=40):
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert len(rows) == len(texts) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    groups = defaultdict(set)
    for r in rows:
        if texts[r["doc_id"]] is not None:
            groups[texts[r["doc_id"]]].add(r["shard"])
    return groups


def test_sharding_keeps_groups_together(spark):
    texts = [f"t{k}" for k in range(600)] + [f"g{k // 4}" for k in range(80)] + [None] * 3
    groups = check_shards(sharding.shard_documents(docs(spark, texts, True)).collect(), texts)
    assert sum(len(s) > 1 for s in groups.values()) == 0


def test_sharding_of_equal_rows_and_cut_edges(spark):
    rows = [(None, "the same")] * 900 + [(k, f"group {k // 6}") for k in range(600)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8)
    placed = out.collect()
    sizes = Counter(r["shard"] for r in placed)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in placed) == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]
    # a group of 900 needs 5 of the shards of 188: 712 of its edges are cut by any
    # sharding, and of the 500 others chance would cut about 400
    cut = sharding.cut_edges(out, "text_crc32").first()
    assert cut["groups"] == 101 and cut["edges"] == 899 + 500 and 712 <= cut["cut"] <= 712 + 200


def test_sharding_of_one_large_group(spark):
    texts = ["same"] * 250 + [f"t{k}" for k in range(500)]
    groups = check_shards(sharding.shard_documents(docs(spark, texts)).collect(), texts)
    assert len(groups["same"]) <= 25
    check_shards(sharding.shard_documents(docs(spark, ["same"] * 101)).collect(), ["same"] * 101)
    check_shards(sharding.shard_documents(docs(spark, ["a", "b"])).collect(), ["a", "b"])


# 4 licences


def test_licences(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code only"), ("a/b/y.py", None), ("a/b/c/z.py", "# Licensed under the Apache License, Version 2.0.\nimport x"), ("d/q.py", ""), ("LICENSE", "nothing here"), (None, "text"), ("a/b/COPYING", "Licensed under CC BY-NC 4.0."), ("a/b/c/w.py", "x"), ("a/x.py", "code only")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("clash"))
    got = licenses.scan(df, "path", F.col("path"), licenses.named_license_file(F.col("path"))).collect()
    assert len(got) == len(rows)
    found = {r["path"]: (r["license"], r["origin"], r["from_directory"]) for r in got}
    assert found["a/LICENSE"][:2] == ("MIT", "own") and found["a/x.py"] == ("MIT", "inherited", "a")
    assert found["a/b/y.py"] == ("CC-BY-NC-4.0", "inherited", "a/b") and found["a/b/c/w.py"] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert found["a/b/c/z.py"][:2] == ("Apache-2.0", "own") and found["d/q.py"] == (None, "none", None) and found[None] == (None, "none", None)


def test_wrapped_notices(spark):
    import textwrap

    tail = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    gnu = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    notices = {
        "GPL-3.0": gnu.format("program", ":", "", ",", "3"), "GPL-2.0": gnu.format("program", ";", "", ";", "2"), "AGPL-3.0": gnu.format("program", ":", "Affero ", ",", "3"), "LGPL-3.0": gnu.format("library", ":", "Lesser ", ",", "3"), "LGPL-2.1": gnu.format("library", ";", "Lesser ", ";", "2.1"),
        "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "MIT": licenses.NOTICES[-5][1],
    }
    rows = []
    for name, notice in notices.items():
        for shape, mark in (("#", "# "), ("*", " * "), ("//", "// "), ("plain", "")):
            wrapped = "\n".join(mark + line for line in textwrap.wrap(notice, 72))
            rows.append((f"{name} {shape}", f"{mark}Copyright (C) 2020 Some Body\n{mark.rstrip()}\n{wrapped}\n{mark.rstrip()}\n{mark}{tail}\nimport x\n"))
        rows.append((f"{name} one", notice + "\n\ncode"))
    rows += [(f"{name} title", f"                    {title}\n                       {version}\n\n Copyright (C) Free Software Foundation, Inc.\n") for name, title, version in (("GPL-3.0", "GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991"))]
    rows += [("None prose", "a free copy of the program\nwas published by the library in version 3\n"), ("two lines", "Released under the MIT License\nLicensed under the Apache License, Version 2.0")]
    rows += [(f"None {k}", t) for k, t in enumerate(prose(100))]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: r for r in licenses.scan(df, "path", F.col("path"), F.lit(False)).collect()}
    assert got["two lines"]["n_licenses"] == 2
    wrong = {p: (r["own_license"], r["own_score"], r["n_licenses"]) for p, r in got.items() if p != "two lines" and (str(r["own_license"]), r["n_licenses"]) != (p.split(" ")[0], int(not p.startswith("None")))}
    assert not wrong


def test_licences_equal_sql(spark, tmp_path):
    """Every statement plain, wrapped behind comment markers, cut in two and
    behind other text, in documents of every kind of path, against the SQL."""
    import textwrap

    import duckdb

    texts = ["", None, " \n\n ", "code\r\n\r\nReleased under the MIT License.\r\n"]
    for k, (_, notice) in enumerate(licenses.TEMPLATES + licenses.NOTICES):
        mark = ("# ", " * ", "// ", "<!-- ", "")[k % 5]
        wrapped = "\n".join(mark + line for line in textwrap.wrap(notice, 40))
        texts += [notice, f"{mark}some title\n{mark.rstrip()}\n{wrapped}\n\ncode", f"x y. {notice[: len(notice) // 2]}\n\n{notice[len(notice) // 2 :]}", f"{notice} {licenses.TEMPLATES[k % 7][1]}\n{wrapped}"]
    texts += prose(150, 3)
    ids = list(range(0, 37 * len(texts), 37))
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, None) for k, (i, t) in enumerate(zip(ids, texts))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = licenses.op4_licenses(spark, str(tmp_path))
    found = duckdb.sql(licenses.ORACLE["op4_licenses"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    rows = {tuple(r) for r in got.collect()}
    assert rows == set(found) and len(found) == len(texts)
    assert {r[5] for r in found} == {"own", "inherited", "none"} and len({r[1] for r in found}) > 12


def test_one_licensed_text_and_one_directory_for_all_rows(spark):
    df = spark.range(3000).select(F.col("id"), F.lit("Released under the MIT License.").alias("text"))
    df = df.union(spark.range(3000, 5000).select("id", F.lit(None).cast("string")))
    got = licenses.scan(df, "id", F.concat(F.lit("a/"), F.col("id")), F.col("id") == 7)
    counts = {(r["license"], r["origin"]): r["count"] for r in got.groupBy("license", "origin").count().collect()}
    assert counts == {("MIT", "own"): 3000, ("MIT", "inherited"): 2000}
    assert licenses.scan(df.limit(0), "id", F.lit(None).cast("string"), F.lit(True)).count() == 0


def test_markers_are_lossless():
    idf = {w: 1.0 + len(w) % 3 for w in licenses.VOCABULARY}
    vectors = licenses.template_weights(idf)
    marks = set(licenses.markers(vectors))
    for v in vectors:
        assert sum(x * x for w, x in v.items() if w not in marks) < licenses.THRESHOLD**2


# 5 token counts


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_path())
    texts = TEXTS + prose(50) + ["  a\n\n b \t c", "'s's 's don't", "1a2.b,c;;", "x   ", "\n", "ab" * 9000]
    rows = token_counts.token_counts(docs(spark, texts, True)).collect()
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 512), repr(texts[r["doc_id"]])[:60]


# 6 mixing


def test_targets_are_a_water_level(spark):
    sources = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50), ("z", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    sizes, weights = {"a": 100, "b": 1000, "c": 10, "z": 0, None: 50}, {"a": 5, "b": 2, "c": 1, "z": 5, None: 2}
    open_, left, expected = set(sizes), 1160.0, {}
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            expected |= share
            break
        expected |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(expected) and sum(got.values()) == pytest.approx(1160)


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, f"s{min(k % 9, 3)}" if k % 50 else None, rng.choice([0, 5, 5, 20, 90])) for k in range(3000)] + [(None, "s1", None), (7, "s1", 5), (7, "s1", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.with_copies(df).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r["__row"]["source"]] += r["copies"] * (r["__row"]["size"] or 0)
        target[r["__row"]["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 3 * 90
    again = mixing.with_copies(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.emit(mixing.with_copies(df)).count() == sum(r["copies"] for r in got)


def test_mixing_of_clashing_names_and_one_id(spark):
    rows = [(None if k % 2 else 4, "s", 3) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for name in ("target", "source_size", "copies", "key", "id", "bucket", "part", "number", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    got = mixing.with_copies(df, weights=(1,)).collect()
    assert len(got) == 400 and sum(r["copies"] for r in got) == 400
    assert mixing.emit(mixing.with_copies(df, weights=(1,))).columns == df.columns


# 7 WARC


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>" * 30_000
    htmls = ["<p>short", "<p>short", long, long, None, "x" * 100, "x" * 100, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9, "y" * 99, "y" * 99]
    rows = [(k, "http://h/a b\r\nX: y" if k % 2 else None, h) for k, h in enumerate(htmls)] + [(None, "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and {r["status"] for r in got} == {"ok"}
    found = {r["page_id"]: r for r in got}
    for k, _, h in rows:
        r, raw = found[None if k is None else str(k)], (h or "").encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest()
    assert {k: r["refers_to"] for k, r in found.items() if r["record_type"] == "revisit"} == {"3": "2", "6": "5", None: "5"}


def test_readers_return_payloads(spark, tmp_path):
    htmls = ["é<p>" * 30_000, "é<p>" * 30_000, None, "x" * 100, "x" * 100, "short"]
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "archives"))
    got = warc.read_archives(spark, str(tmp_path / "archives"))
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got.collect()} == {str(k): h or "" for k, h in enumerate(htmls)}
    thin = warc.read_archives(spark, str(tmp_path / "archives"), payload=False)
    assert thin.columns == got.columns[:-1] and sorted(map(str, thin.collect())) == sorted(map(str, got.drop("payload").collect()))
    media = {r["doc_id"]: r["payload"] for r in ogg.decode(ogg.encode(docs(spark, TEXTS))).collect()}
    assert all(bytes(media[k]).rstrip(b"\xff") == (t or "").encode() for k, t in enumerate(TEXTS))


def test_broken_archives_are_told(spark, tmp_path):
    import gzip

    block = warc._HTTP + warc.chunked(b"z" * 50_000)
    parts = warc.page_records(1, "1", None, b"z" * 50_000, hashlib.sha256(b"z" * 50_000).hexdigest(), None)
    bad = warc.page_records(2, "2", None, b"abc", "0" * 64, None)
    lost = warc.page_records(3, "3", None, b"q" * 50_000, hashlib.sha256(b"q" * 50_000).hexdigest(), None)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [parts[2], parts[0], *bad, *parts[3:], parts[1], *lost[:1], *lost[2:]]))
    got = {r["page_id"]: r["status"] for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert len(block) > 3 * warc.SEGMENT_BYTES
    assert got == {"1": "ok", "2": "bad: payload digest", "3": "bad: segment numbers"}
    with pytest.raises(warc.BadRecord):
        warc.unchunked(b"5\r\nabc")
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


# 8 quality classifier


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_classifier_is_accurate_on_held_out_rows(spark):
    rows = quality_classifier.op8_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_classifier_without_labels_and_odd_rows(spark):
    stats = quality_classifier.document_statistics(docs(spark, TEXTS), ["doc_id"])
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    scored = quality_classifier.apply(quality_classifier.fit(stats, labels), stats).collect()
    assert len(scored) == len(TEXTS) and {r["score"] for r in scored} == {0.5}


def test_isotonic():
    x, y = quality_classifier.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert list(y) == [0, 0.5, 1] or list(np.round(y, 6)) == [0, 0.5, 1.0]
    assert all(np.diff(x) > 0)


# 9 Ogg


def test_ogg_round_trip(spark):
    texts = TEXTS + ["w" * 576, "z" * 577, "long " * 40_000]
    rows = {r["doc_id"]: r for r in ogg.decode(ogg.encode(docs(spark, texts, True))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or 576 * (not raw))
        r = rows[k]
        assert (r["status"], r["n_bytes"], r["payload_bytes"]) == ("ok", len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert sum(t["end"] - t["start"] for t in r["times"]) == pytest.approx(len(payload) / 8000)
    assert rows[0]["media_sha256"] == rows[1]["media_sha256"]


def crc_by_bits(page):
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksums_and_damage():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.page_checksum(data) == crc_by_bits(data)
    media = ogg.encode_payload(bytes(range(256)) * 9 * 100)
    payload, read = ogg.decode_payload(media)
    assert payload == bytes(range(256)) * 900 and read["streams"] == 2
    # every packet has its time, though a page names the end of its last only
    for s in range(2):
        times = [t[1:] for t in read["times"] if t[0] == s]
        size = ogg.FRAME * ogg.PACKET_FRAMES / 8000
        whole = len(payload) / 2 / 8000
        assert times == [(k, pytest.approx(k * size), pytest.approx(min((k + 1) * size, whole))) for k in range(len(times))]
        assert times[-1][2] == pytest.approx(whole)
    for at in (30, 200, len(media) // 2, len(media) - 5):
        with pytest.raises(ogg.BadMedia):
            ogg.decode_payload(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ogg.BadMedia):
        ogg.decode_payload(media[:-10])


def test_ogg_packet_ends():
    assert ogg.packet_ends([], []) == []
    assert ogg.packet_ends([5, 7, 9], [-1, -1, 21]) == [5, 12, 21]
    assert ogg.packet_ends([5, 7, 9], [5, -1, 121]) == [5, 112, 121]
    assert ogg.packet_ends([5, 7, 9], [5, -1, -1]) == [5, 12, 21]


def test_ogg_gap_is_an_error():
    """A valid checksum with a granule position that the packets don't fill."""
    head = ogg.make_page(ogg.FIRST, 0, 8, 0, bytes([ogg._IDENT_SIZE]), ogg.struct.pack(ogg._IDENT, ogg._MAGIC, 0, 1, 8000, ogg.FRAME))
    for granule, good in ((576, True), (577, False), (575, False), (0, False)):
        media = head + ogg.make_page(ogg.LAST, granule, 8, 1, bytes([255, 255, 66]), b"a" * 576)
        if good:
            assert ogg.decode_payload(media)[1]["times"] == [(0, 0, 0.0, 0.072)]
        else:
            with pytest.raises(ogg.BadMedia):
                ogg.decode_payload(media)


def test_bad_media_column(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert {r["doc_id"]: r["status"].split(":")[0] for r in ogg.decode(df).collect()} == {1: "no media", 2: "bad"}


# 10 near-duplicates


def edited(text, rng, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    base = prose(60, 3)
    texts = TEXTS + base + [edited(rng.choice(base), rng, rng.randint(0, 8)) for _ in range(150)]
    hub = prose(1, 9, size=(150, 151))[0]
    texts += [edited(hub, rng, rng.randint(1, 14)) for _ in range(120)] + [hub.upper()] * 3
    for width, percent in ((3, 85), (5, 80)):
        rows = near_duplicates.near_duplicates(docs(spark, texts, True), width=width, percent=percent).collect()
        expected = brute.components(list(enumerate(texts)), width, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (5, ""), (None, None)], "doc_id long, text string")
    rows = near_duplicates.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == Counter({(3, 3): 2, (None, 3): 1, (5, 5): 1, (None, None): 1})


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[600:3600])
    s = near_duplicates.sketch([a, b, np.union1d(a, b)])
    assert (near_duplicates.merge(s[0], s[1]) == s[2]).all()
    j = near_duplicates.joint_similarity(s[:1], s[1:2], np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert abs(j - 2400 / 3600) < 0.15


def test_components_of_a_short_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_duplicates.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_components_of_a_long_chain_in_random_order(spark):
    """Rounds don't grow with the length of a path."""
    ids = list(range(5000))
    random.Random(2).shuffle(ids)
    links = list(zip(ids, ids[1:])) + [(7000, 7000 + k) for k in range(1, 300)]
    got = {r["node"]: r["component"] for r in near_duplicates.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in ids} | {k: 7000 for k in range(7000, 7300)}


def test_near_duplicates_of_a_chain(spark):
    """Every text is near to the next alone; the ids are in random order."""
    words = [f"w{k}" for k in range(5 * 120 + 102)]
    ids = list(range(120))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, " ".join(words[5 * k : 5 * k + 102])) for k, i in enumerate(ids)], "doc_id long, text string")
    assert {r["component_id"] for r in near_duplicates.near_duplicates(df, width=3, percent=85).collect()} == {0}


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bands_lose_next_to_nothing(percent):
    registers, band = near_duplicates.bands(percent)
    j = percent / 100
    up = -np.log1p(-(1 - j) / 2 * (near_duplicates.BASE - 1) / near_duplicates.BASE) / np.log(near_duplicates.BASE)
    assert registers % band == 0 and (1 - (1 - 2 * up) ** band) ** (registers // band) < near_duplicates.MISS


# equal hashes are not equal texts


def thue_morse(n):
    a, b = b"a", b"b"
    while len(a) < n:
        a, b = a + b, b + a
    return a.decode(), b.decode()


def sliced(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]).astype(np.int64)


COLLIDING = [w for n in (64, 1024, 2048) for w in thue_morse(n)]


@pytest.fixture(params=["full", "two bits"])
def hashes(request, monkeypatch):
    """The hash as it is, and one under which nearly everything collides."""
    if request.param == "two bits":
        real = textkit.Hasher.of
        monkeypatch.setattr(textkit.Hasher, "of", lambda self, starts, ends, seed=0: real(self, starts, ends, seed) & np.uint64(3))
    return request.param


def test_measures_compare_texts(hashes):
    texts = ["\n".join(COLLIDING), " ".join(COLLIDING * 2), " ".join(f"{w} x y" for w in COLLIDING), *prose(6, 5, 20, (5, 40)), "\n".join(prose(9, 6, 3, (1, 3)))]
    got = np.stack(quality_rules.measure(*sliced(texts))[:6], axis=1)
    assert [tuple(map(int, row)) for row in got] == [brute.measures(t) for t in texts]


def test_token_counts_compare_texts(hashes):
    from tokenizers import Tokenizer

    path = token_counts.default_path()
    library = Tokenizer.from_file(path)
    merger = token_counts.Merger(open(path, encoding="utf-8").read())
    texts = COLLIDING + prose(8, 7) + ["a <|endoftext|> b"]
    for _ in range(2):  # the second time from the cache
        assert merger.count_slice(*sliced(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_compare_texts(hashes):
    path = packing.default_path()
    encoder = packing.Encoder(open(path, encoding="utf-8").read())
    texts = COLLIDING + prose(8, 7)
    for _ in range(2):
        ids, ends = encoder.encode(*sliced(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_shared_shingles_compare_texts(hashes):
    texts = [*COLLIDING, " ".join(COLLIDING), " ".join(COLLIDING[::-1]), *prose(5, 8, 12, (4, 60))]
    sets = near_duplicates.Sets([{"text": t} for t in texts], 3)
    plain = [brute.shingles(t, 3) for t in texts]
    assert sets.sizes.tolist() == [len(s) for s in plain]
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert sets.shared(i, sets, j) == len(a & b)


def test_colliding_words_are_not_near_copies(spark):
    rows = [(k, w) for k, w in enumerate(COLLIDING)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


# the pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit(1)).withColumn("stats", F.lit("clash")).cache()
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    kept = corpus_pipeline.rules(spark, table, SF)
    assert kept.columns == table.columns
    passed = {i for i, t in text.items() if brute.measures(t)[0] >= 50}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= passed and len(ids) > 0.6 * len(passed)
    scored = corpus_pipeline.classifier(spark, kept, SF)
    ids = {r["doc_id"] for r in scored.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in ids) == 0
    expected = brute.components([(i, text[i]) for i in ids], 5, 80)
    single = corpus_pipeline.near_dedup(spark, scored, SF)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c in expected.values()})
    mixed = corpus_pipeline.mix(spark, single, SF)
    assert mixed.columns == table.columns
    packed = corpus_pipeline.pack(spark, mixed, SF)
    firsts = Counter(r["doc_id"] for r in packed.filter("piece = 0").collect())
    assert firsts == Counter(r["doc_id"] for r in mixed.collect())


def test_near_dedup_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "A b c d"), (None, "e f g h"), (None, "e f g h"), (4, "x y z"), (4, "other words here"), (5, ""), (5, ""), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit("clash")).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, table, SF)
    assert kept.columns == table.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(3, "a b c d"): 1, (None, "e f g h"): 1, (4, "x y z"): 1, (4, "other words here"): 1, (5, ""): 2, (None, None): 1})


def test_slices_hold_whole_documents():
    import pyarrow as pa

    texts = ["a" * (textkit.SLICE_BYTES + 5), None, "b", "c" * 10]
    batch = pa.record_batch([pa.array(texts)], names=["text"]).slice(1)
    parts = [(rows.num_rows, bytes(data)) for rows, data, _ in textkit.slices(batch)]
    assert sum(n for n, _ in parts) == 3 and b"".join(d for _, d in parts) == b"b" + b"c" * 10


def test_saved_tables_are_dropped(spark):
    from tidemark.llm.saved import drop, saved

    table, other = saved(spark.range(5)), saved(spark.range(3))
    drop(table)
    assert not os.path.exists(table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) and other.count() == 3


def test_joins_on_one_heavy_key(spark):
    from tidemark.llm.spread import heavy, spread_join

    rows = spark.range(5000).select((F.when(F.col("id") < 4000, 7).otherwise(F.col("id"))).alias("key"), "id")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    joined = spread_join(rows, sizes, "key", F.col("id"), heavy(sizes, "key", "n"))
    assert joined.count() == 5000 and joined.filter("key = 7 AND n = 4000").count() == 4000
    assert spread_join(rows, sizes.filter("key > 4500"), "key", F.col("id"), heavy(sizes, "key", "n"), "left").count() == 5000
    assert [r["__parts"] for r in heavy(sizes, "key", "n").filter("__heavy = 7").collect()] == [1000]
