"""Clustering, collocations and fingerprints: brute force and edge cases."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from brute import LOWER
from pyspark.sql import functions as F

from tidemark.llm import centroids, fingerprints, licenses, phrases

VECTORS = "vec_id long, embedding array<double>"
DOCS = "doc_id long, text string, lang string"


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


# 11 centroid clustering


def lloyd(rows, size, k, rounds, seed, scale):
    """Everything compared with everything, in exact integers."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]

    def packed(q):
        small = all(-(1 << 15) <= x < 1 << 15 for x in q)
        return np.array(q, "<i2").tobytes() if small else ",".join(map(str, q)).encode()

    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), packed(r[1])))
    means = [q for _, q in order[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(means))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in kept:
            groups[nearest(q)[1]].append(q)
        means = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if groups[n] else c for n, c in enumerate(means)]
    found = [(i, *nearest(q)) for i, q in kept]
    own = Counter()
    for _, d, n in found:
        own[n] += d
    return sorted(((i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, means[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def clustered(df, **how):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    out = centroids.delta_lloyd(df, **how)
    assert out.columns == names
    return sorted((tuple(r[n] for n in names) for r in out.collect()), key=str)


def test_delta_lloyd_against_lloyd(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(0, 0.3, 4) + rng.integers(0, 3, 4)).tolist()) for k in range(150)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [0.5] * 4), (None, [0.5] * 4)]  # repeated rows, null ids
    rows += [(900, None), (901, [1.0] * 3), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]), (904, [math.nan, 0.0, 0.0, 0.0]), (905, [math.inf, 0.0, 0.0, 0.0]), (906, [])]
    rows += [(910, [-200.25, 500.0, 0.0, 1e-9]), (911, [3000.5, -0.001, 0.0, 0.0])]  # no two bytes hold these
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(5), "owner", "distance", "cluster", "id", "kind", "vector")
    for k, rounds in ((6, 5), (1, 2), (400, 3)):
        assert clustered(df, size=4, k=k, rounds=rounds, scale=256) == lloyd(rows, 4, k, rounds, 2, 256)


def test_delta_lloyd_breaks_ties_by_number_and_keeps_empty_centroids(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(12)]
    assert clustered(spark.createDataFrame(rows, VECTORS), size=2, k=5, rounds=4) == lloyd(rows, 2, 5, 4, 2, 256)


def test_delta_lloyd_of_huge_components_is_exact(spark):
    rows = [(k, [1e9 * k, -3e8, 0.125]) for k in range(9)]
    assert clustered(spark.createDataFrame(rows, VECTORS), size=3, k=3, rounds=3, scale=1) == lloyd(rows, 3, 3, 3, 2, 1)
    beyond = spark.createDataFrame([(0, [1e30, 0.0]), (1, [0.0, 0.0])], VECTORS)
    assert {r[2] for r in clustered(beyond, size=2, k=1, rounds=0)} <= {0, None}


def test_delta_lloyd_of_nothing(spark):
    assert clustered(spark.createDataFrame([(1, None)], VECTORS)) == []
    assert clustered(spark.createDataFrame([], VECTORS)) == []


# 12 collocations


def mined(rows, longest, least, percent, most):
    texts = [(lang if lang is not None else "und", [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))]) for _, text, lang in rows]
    out = []
    for lang in {lang for lang, _ in texts}:
        f, n = Counter(), 0
        for own, pieces in texts:
            for words in pieces if own == lang else []:
                n += len(words)
                f.update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in good.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= percent * a for q, b in good.items())
            if not inside:
                rows_.append((score, a, " ".join(p), f[p[:k]], f[p[k:]], n))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, rank, p, a, left, right, n, score) for rank, (score, a, p, left, right, n) in enumerate(rows_[:most], 1)]
    return sorted(out)


def found(df, **how):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    out = phrases.collocations(df, **how)
    assert out.columns == names
    return sorted(tuple(r[n] for n in names) for r in out.collect())


def sample_texts(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "é", "日本", "a\x1fb", "don't", "x" * 300, "go", "to", "the", "of"]
    fixed = ["new York city", "to the end of", "日本 é", "go go go go"]
    texts = []
    for k in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        texts.append((k, "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for p in parts), rng.choice(["en", "en", "en", "de", None])))
    return texts + [(n, None, "en"), (n + 1, "", None), (n + 2, "solo", "zz"), (n + 3, "new york " * 3000, "de"), (None, "new york city", "en")]


@pytest.mark.parametrize("least,percent,most", [(3, 100, 2000), (20, 60, 5), (1, 100, 50)])
def test_collocations_against_brute_force(spark, least, percent, most):
    rows = sample_texts(60)
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(4), "phrase", "f", "n", "block", "k", "m", "a", "l", "r", "rank", "score")
    assert found(df, least=least, percent=percent, most=most) == mined(rows, 5, least, percent, most)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    """With nearly all cells full the exact pass decides."""
    monkeypatch.setattr(phrases, "LEAST_CELLS", 1 << 16)
    monkeypatch.setattr(phrases, "MOST_CELLS", 1 << 16)
    monkeypatch.setattr(phrases, "HELD_CELLS", 500)
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(1500)) + " New York" * (k % 3), "en") for k in range(30)]
    assert found(spark.createDataFrame(rows, DOCS).repartition(6), least=5) == mined(rows, 5, 5, 100, 2000)


def test_collocations_of_nothing(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
    assert found(spark.createDataFrame([(1, None, None), (2, " .. ", "en")], DOCS), least=1) == []


def test_sketch_cells_are_never_below_the_counts():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 62, 3000).astype(np.uint64)[rng.integers(0, 3000, 20000)]
    cells = phrases.cells(hashes, 16, 1)
    cell, count = phrases.counted(cells.astype(np.uint32))
    per = dict(zip(cell.tolist(), count.tolist()))
    for h, n in Counter(hashes.tolist()).items():
        assert per[int(phrases.cells(np.array([h], np.uint64), 16, 1)[0])] >= n
    gaps = np.diff(cell, prepend=0)
    back, counts = phrases.unpacked(phrases.packed(gaps, np.minimum(count, 100).astype("<u2")))
    assert np.array_equal(back, cell) and np.array_equal(counts, np.minimum(count, 100))


# 13 fingerprints


def spark_hash(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def plain_print(text, samples):
    """The samples of a text, word by word."""
    words = Counter(w for w in re.split("[ \t-\r]+", text.lower()) if w)
    if not words:
        return ""
    best = [math.inf] * samples
    for word, n in words.items():
        h = struct.pack("<Q", spark_hash(word.encode()))
        for k in range(samples):
            bits = spark_hash(struct.pack("<i", k), spark_hash(h))
            u = [((bits >> s & 4095) + 0.5) / 4096 for s in (0, 12, 24, 36, 48)]
            r, c = -math.log(u[0] * u[1]), -math.log(u[2] * u[3])
            t = math.floor(math.log(n) / r + u[4])
            best[k] = min(best[k], math.log(c) - r * (t + 1 - u[4]))
    return best


FINGER = [(9, "a b c d e f g", "x"), (8, "a b c d e f h", "x"), (8, "other words here", None), (7, None, None), (6, "", "x"), (5, " \n\t ", "x"), (4, "é日本 b b b b", "x"), (None, "no id", "x"), (3, "long " * 4000 + "tail", "x"), (2, "a b c d e f g", "x"), (1, "one", "x"), (1, "one", "x")]


def order(rows):
    return sorted(((-i if i is not None else 1 << 62, hashlib.md5((t or "").encode()).hexdigest(), i, t or "") for i, t, _ in rows))


def edited_texts(rows):
    line = order(rows)
    out = []
    for (_, _, i, t), (_, _, _, after) in zip(line, line[1:] + line[:1]):
        h = len(t) // 2
        out.append((i, t, t[: len(t) - h] + after[:h], after))
    return out


def test_fingerprints_against_brute_force(spark):
    df = clashing(spark.createDataFrame(FINGER, DOCS).repartition(4), "key", "digest", "range", "place", "next", "edited", "id", "n")
    got = Counter()
    for r in fingerprints.fingerprints(df).collect():
        got[r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 6), round(r["near_next"], 6)] += 1
    by_text = {}
    for i, n, _, mark, *_ in got:
        for j, t, _ in FINGER:
            if i == j and n == len(t or ""):
                by_text.setdefault((t or "", n), set()).add(mark)
    prints = {t: plain_print(t, fingerprints.SAMPLES) for _, t, e, _ in edited_texts(FINGER)} | {e: plain_print(e, fingerprints.SAMPLES) for _, t, e, _ in edited_texts(FINGER)}

    def near(a, b):
        x, y = prints[a], prints[b]
        if not x or not y:
            return float(x == y)
        return round(sum(p == q for p, q in zip(x, y)) / fingerprints.SAMPLES, 6)

    expected = Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest(), near(t, e), near(t, after)) for i, t, e, after in edited_texts(FINGER))
    assert Counter({}) == expected - Counter([(i, n, sha, a, b) for (i, n, sha, _, _, a, b), k in got.items() for _ in range(k)])
    assert sum(got.values()) == len(FINGER)


def test_equal_texts_have_equal_fingerprints_and_empty_ones_none(spark):
    rows = fingerprints.fingerprints(spark.createDataFrame(FINGER, DOCS)).collect()
    marks = defaultdict(set)
    for r in rows:
        marks[r["doc_id"]].add(r["fingerprint"])
    assert marks[9] == marks[2] and marks[7] == marks[6] == marks[5] == {""}
    assert all(len(m) == 4 * fingerprints.SAMPLES or m == "" for own in marks.values() for m in own)


def test_likeness_is_the_generalised_jaccard_similarity(spark):
    rng = random.Random(2)
    # neighbours share half of their words and others none, so estimates are independent
    rows = [(k, " ".join(f"w{20 * k + rng.randint(0, 39)}" for _ in range(200)), None) for k in range(300)]
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    gaps = []
    for (_, _, i, t), (_, _, _, after) in zip(order(rows), order(rows)[1:] + order(rows)[:1]):
        a, b = Counter(t.split()), Counter(after.split())
        gaps.append(got[i] - sum((a & b).values()) / sum((a | b).values()))
    # 300 estimates with a standard error of about 0.07 each
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.11


def test_ranges_cover_a_key_with_most_rows(spark):
    rows = [(5 if k % 3 else k, f"text {k}", None) for k in range(400)]
    got = Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter((i, hashlib.sha256(e.encode()).hexdigest()) for i, _, e, _ in edited_texts(rows))


def test_fingerprints_of_one_and_of_none(spark):
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d", None)], DOCS)).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()
    assert fingerprints.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints_run_without_python_workers(spark):
    plan = fingerprints.fingerprints(spark.createDataFrame(FINGER, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 7 WARC: identifiers, one payload for all rows, damage


def test_page_ids_of_any_text_come_back(spark, tmp_path):
    from tidemark.llm import warc

    ids = [" a ", "b\r\nX-Row: 9", "100%", "é日本", "", "<x>", "a%20b", None]
    rows = [(i, "u", "z" * 200 if k % 2 else f"page {k} " * 20) for k, i in enumerate(ids)]
    pages = clashing(spark.createDataFrame(rows, "page_id string, url string, html string"), "row", "payload", "origin", "one", "status", "record_id")
    warc.write_archives(pages, str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a"), payload=False).collect()
    assert {r["status"] for r in got} == {"ok"} and Counter(r["page_id"] for r in got) == Counter(ids)
    first = min(i for k, i in enumerate(ids) if k % 2 and i is not None)
    assert {r["page_id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {i: first for k, i in enumerate(ids) if k % 2 and i != first}


def test_one_payload_for_all_pages(spark, tmp_path):
    from tidemark.llm import warc

    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("same " * 50).alias("html")).repartition(6)
    warc.write_archives(pages, str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a"), payload=False)
    assert got.groupBy("record_type", "status").count().orderBy("record_type").collect() == [("response", "ok", 1), ("revisit", "ok", 2999)]
    assert got.filter("refers_to <> '0'").count() == 0 and got.select("page_id").distinct().count() == 3000


def test_a_cut_archive_is_told_and_others_are_read(spark, tmp_path):
    import gzip

    from tidemark.llm import warc

    def page(k):
        body = f"page {k} ".encode() * 30
        return b"".join(warc.page_records(k, str(k), None, body, hashlib.sha256(body).hexdigest(), None))

    (tmp_path / "good.warc.gz").write_bytes(gzip.compress(page(1)))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(page(2)) + gzip.compress(page(3))[:-20])
    (tmp_path / "plain.warc").write_bytes(page(4) + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length")
    (tmp_path / "noise.warc.gz").write_bytes(b"\x1f\x8bnoise")
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert {r["page_id"] for r in rows if r["status"] == "ok"} >= {"1", "2", "4"}
    damaged = {r["record_id"].rsplit("/", 1)[1] for r in rows if r["record_type"] == "damaged"}
    assert damaged == {"cut.warc.gz", "plain.warc", "noise.warc.gz"} and all(r["status"].startswith("bad: ") for r in rows if r["record_type"] == "damaged")


def test_archives_of_no_pages(spark, tmp_path):
    from tidemark.llm import warc

    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0


# 9 Ogg: a second reader, byte by byte


def crc_by_bits(page):
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def plain_pages(media):
    """(serial, number, flags, granule, segments, body) of each page, and the bytes read."""
    at, out = 0, []
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        flags, granule = media[at + 5], int.from_bytes(media[at + 6 : at + 14], "little", signed=True)
        serial, number, crc = (int.from_bytes(media[at + k : at + k + 4], "little") for k in (14, 18, 22))
        segments = media[at + 27 : at + 27 + media[at + 26]]
        end = at + 27 + len(segments) + sum(segments)
        assert crc == crc_by_bits(media[at : at + 22] + bytes(4) + media[at + 26 : end])
        out.append((serial, number, flags, granule, segments, media[at + 27 + len(segments) : end]))
        at = end
    return out


def test_ogg_digests_and_features_by_a_second_reader(spark):
    from tidemark.llm import ogg

    texts = ["", None, "one", "é日本 " * 90, "x" * 576, "tab\t and line\n" * 700]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "media", "status", "payload", "times")
    stored = ogg.encode(df).collect()
    read = {r["doc_id"]: r for r in ogg.decode(spark.createDataFrame([(r["doc_id"], r["media"]) for r in stored], "doc_id long, media binary"), payload=False).collect()}
    for row in stored:
        r, raw, media = read[row["doc_id"]], (texts[row["doc_id"]] or "").encode(), bytes(row["media"])
        payload = raw + b"\xff" * ((-len(raw)) % 576 or 576 * (not raw))
        pages = plain_pages(media)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        tracks, last = {}, {}
        for serial, number, flags, granule, segments, body in pages:
            own = tracks.setdefault(serial, [b""])
            assert bool(flags & 2) == (number == 0)
            at = 0
            for size in segments:
                own[-1] += body[at : at + size]
                at += size
                if size < 255:
                    own.append(b"")
            if granule > 0:
                last[serial] = granule
        packets = {s: own[1:-1] for s, own in tracks.items()}
        frames = {s: [b"".join(p)[k : k + 576] for k in range(0, len(b"".join(p)), 576)] for s, p in packets.items()}
        line = [frames[s][k] for k in range(max(map(len, frames.values()))) for s in sorted(frames) if k < len(frames[s])]
        assert b"".join(line) == payload
        samples = [b - 128 for b in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(samples, samples[1:]))
        starts = [sum(map(len, p[:-1])) / 8000 for p in packets.values() if p]
        expected = f"streams={len(tracks)};pages={len(pages)};packets={sum(map(len, packets.values()))};seconds={max(last.values()) / 8000:.3f};last_start={max(starts):.3f};mean={sum(samples) / len(samples):.4f};energy={sum(x * x for x in samples)};crossings={crossings}"
        assert r["feature"] == expected


# 4 licences with very common words


def generated(spark, since):
    """The most rows that a Generate of an execution from number `since` on made."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions, most = store.executionsList(), 0
    for i in range(executions.size()):
        number = executions.apply(i).executionId()
        if number < since:
            continue
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for metric in (metrics.apply(k) for k in range(metrics.size()) if node.name() == "Generate"):
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


def test_common_words_of_licences_make_no_rows(spark, tmp_path):
    """A word pair with a marker word, many times in many texts, as one passage
    and as many, is scored without a row per word, passage or line of it."""
    import duckdb

    notice = licenses.TEMPLATES[0][1]
    texts = [f"Item {k}. " + ("is license " * 200 if k % 2 else "is license. " * 200 + "is license\n" * 200) for k in range(40)]
    texts += [texts[k] + f"\n\n{notice}\n\n" * (1 + k) + (licenses.TEMPLATES[3][1] if k % 3 else f"{notice}\n{notice}") for k in range(8)]
    # a word that is stated twice, or that no template has, counts for the norm
    texts += [notice.replace("MIT", "MIT " + more) for more in ("MIT", "mit license license", "any any", "x x", "x y", "released released released")]
    texts += [f"item {k} of many" for k in range(600)]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList()
    since = 1 + max((before.apply(i).executionId() for i in range(before.size())), default=-1)
    got = {tuple(r) for r in licenses.op4_licenses(spark, str(tmp_path)).collect()}
    profile = licenses.profiled(spark.read.parquet(str(tmp_path / "documents.parquet")), "text", F.col("doc_id"))
    idf, _ = licenses.inverse_frequencies(profile)
    assert "license" in licenses.markers(licenses.template_weights(idf, licenses.TEMPLATES + licenses.NOTICES))
    found = duckdb.sql(licenses.ORACLE["op4_licenses"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert got == set(found) and len(found) == len(texts)
    assert len({r[2] for r in found}) > 4 and {r[3] for r in found} == {0, 1, 2}
    assert 0 < generated(spark, since) < 6 * len(texts)
