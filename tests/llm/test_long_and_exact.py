"""Sharding against the smallest cut, the classifier against exact kernel ridge,
and texts longer than a slice in the operators that read texts by slices."""

import random
from collections import defaultdict

import brute
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import near_duplicates, packing, quality_classifier, quality_rules, sharding, textkit, token_counts


def smallest_cut(groups, quotas):
    """Fewest edges of stars of these sizes that a split into shards of these
    sizes cuts, where shards may be left with room for documents without links:
    by trying all places of all groups, with what is over spread anywhere."""
    best = [sum(groups)]

    def place(k, room, cut):
        if cut >= best[0]:
            return
        if k == len(groups):
            best[0] = cut
            return
        for s in sorted(set(room), reverse=True):
            # the group's fullest shard takes as much as fits; the rest goes to
            # the shards with least room, which keeps the others whole
            left = list(room)
            left.remove(s)
            here = min(s, groups[k])
            rest = groups[k] - here
            left.append(s - here)
            for j in sorted(range(len(left)), key=lambda j: left[j]):
                took = min(rest, left[j])
                left[j] -= took
                rest -= took
            place(k + 1, left, cut + groups[k] - here)

    place(0, quotas, 0)
    return best[0]


def test_sharding_cuts_as_little_as_any_split(spark):
    rng = random.Random(5)
    for shards, groups, alone, more in ((3, [rng.randint(2, 7) for _ in range(6)], 30, 0), (4, [9, 8, 7, 6, 5, 4], 25, 0), (2, [30, 3, 3], 6, 6)):
        texts = [f"g{k}" for k, n in enumerate(groups) for _ in range(n)] + [f"alone {k}" for k in range(alone)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        out = sharding.shard_documents(df, shards=shards)
        quotas = [len(texts) // shards + (k < len(texts) % shards) for k in range(shards)]
        cut = sharding.cut_edges(out, "text_crc32").first()
        assert cut["edges"] == sum(n - 1 for n in groups)
        # a group that no shard holds keeps the shards it is on, so its fullest
        # isn't filled up: `more` edges at most
        least = smallest_cut(groups, quotas)
        assert least <= cut["cut"] <= least + more


def labelled(spark, n=400):
    draw = np.random.default_rng(2)
    stats = draw.normal(size=(n, quality_classifier.N_STATS))
    y = (stats[:, 0] * stats[:, 1] + stats[:, 2] > 0).astype(int)
    df = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(stats)], "doc_id long, stats array<double>")
    return stats, y, df, spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int")


def test_classifier_equals_the_dense_solution(spark):
    """Partition sums give the coefficients that least squares over all rows at
    once gives."""
    stats, y, df, labels = labelled(spark)
    model = quality_classifier.fit(df, labels)
    out = {r["doc_id"] for r in df.filter(quality_classifier.held_out()).collect()}
    known = np.array([k for k in range(len(y)) if k not in out])
    mean, spread = stats.mean(axis=0), stats.std(axis=0)
    assert np.allclose(model.mean, mean) and np.allclose(model.spread, spread)
    z = quality_classifier.transform(stats[known], mean, spread)
    penalty = np.sqrt(np.append(np.full(quality_classifier.FEATURES, quality_classifier.RIDGE), 1e-9))
    dense = np.linalg.lstsq(np.concatenate([z, np.diag(penalty)]), np.concatenate([y[known], np.zeros(len(penalty))]), rcond=None)[0]
    assert np.allclose(z @ model.beta, z @ dense, atol=1e-6)
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.apply(model, df.withColumn("score_", F.lit("clash"))).collect()}
    assert np.allclose([scored[k] for k in range(len(y))], model.score(stats))


def test_classifier_is_near_exact_kernel_ridge(spark):
    """Random features approximate the Gaussian kernel, and their ridge scores
    those of kernel ridge."""
    stats, y, df, labels = labelled(spark)
    x = np.clip((stats - stats.mean(axis=0)) / stats.std(axis=0), -quality_classifier.CLIP, quality_classifier.CLIP)
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    kernel = np.exp(-apart / (2 * quality_classifier.SCALE**2))
    z = quality_classifier.transform(stats, stats.mean(axis=0), stats.std(axis=0))[:, :-1]
    # each entry is a mean of FEATURES terms between -2 and 2
    assert np.abs(z @ z.T - kernel).max() < 6 / np.sqrt(quality_classifier.FEATURES)
    model = quality_classifier.fit(df, labels)
    out = {r["doc_id"] for r in df.filter(quality_classifier.held_out()).collect()}
    known = np.array([k for k in range(len(y)) if k not in out])
    centre = y[known].mean()
    exact = centre + kernel[:, known] @ np.linalg.solve(kernel[np.ix_(known, known)] + quality_classifier.RIDGE * np.eye(len(known)), y[known] - centre)
    mine = quality_classifier.transform(stats, model.mean, model.spread) @ model.beta
    assert np.corrcoef(exact, mine)[0, 1] > 0.9


def long_texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n", " #"]) for _ in range(220_000))
    assert len(long) > textkit.SLICE_BYTES
    changed = long.split(" ")
    for k in range(0, len(changed), 300):
        changed[k] = "changed"
    return [long, " ".join(changed), "short one. " * 30, "", None]


def test_tokens_of_texts_longer_than_a_slice(spark):
    from tokenizers import Tokenizer

    texts = long_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(token_counts.default_path())
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    library = Tokenizer.from_file(packing.default_path())
    found = defaultdict(list)
    for r in sorted(packing.pieces(df).select("doc_id", "piece", "ids").collect()):
        found[r["doc_id"]] += r["ids"]
    assert found == {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}


def test_texts_longer_than_a_slice(spark):
    texts = long_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.ledger(df, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_lines"]) == brute.measures(t)
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(df, width=3, percent=85).collect()}
    sets = [brute.shingles(t, 3) for t in texts]
    assert 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1])
    assert [near[k] for k in range(5)] == [(len(s), c) for s, c in zip(sets, [0, 0, 2, 3, 4])]
    stats = {r["doc_id"]: r["stats"] for r in quality_classifier.document_statistics(df, ["doc_id"]).collect()}
    assert stats[0] != stats[1] and np.isclose(stats[0][0], np.log1p(brute.measures(texts[0])[0])) and set(stats[3]) == {0.0} == set(stats[4])
