"""Hand-computed fixtures and properties of the observation operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.expressions import canonical_label, correlation_p, erfc, parse_timestamp, valid
from tidemark.functions.ranks import average_ranks, neighbours, positions
from tidemark.operators import api, layers, models, plausibility, quality, resample, scenarios, stats
from tidemark.schema import FOLDS, METRICS, SOURCE_COLUMNS, SOURCE_SCHEMA
from tidemark.sources import observations as sources


def raw(spark, rows):
    """Raw rows from dicts; what isn't given is a plain value."""
    base = {"city": "Pune", "zone": "Central", "timestamp_text": "2026-01-01 00:00:00", **{m: 1 for m in METRICS}}
    made = []
    for k, row in enumerate(rows):
        full = base | {"record_id": f"R{k}"} | row
        made.append((k + 2, *(float(full[c]) if f.dataType.typeName() == "double" and full[c] is not None else full[c] for c, f in zip(SOURCE_COLUMNS, SOURCE_SCHEMA.fields))))
    schema = "source_row_number long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SOURCE_SCHEMA.fields)
    return spark.createDataFrame(made, schema)


def canon(spark, rows):
    return layers.canonical(layers.dedup_exact(raw(spark, rows)))


def test_dedup_treats_nulls_as_equal(spark):
    same = {"record_id": "A", "traffic_volume": None}
    table = raw(spark, [same, same, same | {"temperature_c": None}])
    assert layers.dedup_exact(table).count() == 2
    log = layers.dedup_log(table).orderBy("source_row_number").collect()
    assert [(r["source_row_number"], r["duplicate_group_size"], r["action"]) for r in log] == [(2, 2, "kept"), (3, 2, "removed_exact_duplicate")]


def test_key_conflict_raises(spark):
    table = raw(spark, [{"record_id": "A"}, {"record_id": "A", "traffic_volume": 9}])
    with pytest.raises(sources.ContractError):
        layers.check_keys(layers.dedup_exact(table))


def test_header_contract(spark):
    with pytest.raises(sources.ContractError):
        sources.check_header(spark.createDataFrame([(1,)], "x int"))


def test_csv_contract(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(",".join(SOURCE_COLUMNS) + "\n" + "A,Pune,,2026-01-01 00:00,1,2.5,3,4,5,6,7,8,\n")
    rows = sources.read_csv(spark, str(good)).collect()
    assert rows[0]["zone"] is None and rows[0]["avg_speed_kmph"] == 2.5
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(sources.ContractError):
        sources.read_csv(spark, str(bad))


def test_zone_labels(spark):
    names = ["central", "NORTH", " West ", "", "  ", None, "new ZONE"]
    rows = spark.createDataFrame([(x,) for x in names], "z string").select(canonical_label(F.col("z")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["Central", "North", "West", None, None, None, "New zone"]


def test_zone_flags(spark):
    flags = quality.quality_flags(canon(spark, [{"zone": z} for z in ("", None, "  ", "north", "North")]))
    found = {(r["record_id"], r["flag_type"]) for r in flags.filter("field_name = 'zone'").collect()}
    assert found == {("R0", "missing"), ("R0", "unknown"), ("R1", "missing"), ("R1", "unknown"), ("R2", "corrected"), ("R3", "corrected")}


def test_timestamps(spark):
    rows = spark.createDataFrame([("2026-01-01 04:00:00",), ("2026-01-01 04:00",), ("garbage",), (None,)], "t string").select(parse_timestamp(F.col("t")).alias("ts")).collect()
    assert [r["ts"] for r in rows] == [dt.datetime(2026, 1, 1, 4), dt.datetime(2026, 1, 1, 4), None, None]
    with pytest.raises(sources.ContractError):
        layers.check_timestamps(canon(spark, [{"timestamp_text": "garbage"}]))


def test_bounds(spark):
    rows = canon(spark, [{"avg_speed_kmph": v} for v in (-0.1, 0.0, 120.0, 120.1, None)]).orderBy("record_id").select(F.coalesce(valid("avg_speed_kmph"), F.lit(False)).alias("v")).collect()
    assert [r["v"] for r in rows] == [False, True, True, False, False]
    cases = [{"parking_occupancy_pct": 100.0}, {"parking_occupancy_pct": 100.1}, {"temperature_c": 44.9}, {"temperature_c": 45.0}, {"power_outage_minutes": 60.0}, {"power_outage_minutes": 60.1}]
    flagged = {r["record_id"] for r in quality.quality_flags(canon(spark, cases)).collect()}
    assert flagged == {"R1", "R3", "R5"}


def test_neighbours_and_decisions(spark):
    days = ["2026-01-31 00:00:00", "2026-01-31 04:00:00", "2026-02-01 00:00:00", "2026-02-01 04:00:00", "2026-03-05 00:00:00"]
    layer = canon(spark, [{"temperature_c": t, "timestamp_text": d} for t, d in zip((20.0, 25.0, 40.0, None, 41.0), days)])
    daily = spark.createDataFrame([("Pune", dt.date(2026, m, 1), 0.0, 39.0) for m in (1, 2, 3)], "city string, obs_date date, t_min double, t_max double")
    rows = {r["record_id"]: r for r in plausibility.neighbour_validation(layer, daily).collect()}
    assert [rows[f"R{k}"]["neighbour_status"] for k in range(5)] == ["insufficient", "inconsistent", "inconsistent", "unknown", "insufficient"]
    assert [rows[f"R{k}"]["decision"] for k in range(5)] == ["not_assessed", "flag_for_review", "probable_error", "not_assessed", "not_assessed"]


def test_neighbours_cross_chunks(spark):
    rng = np.random.default_rng(1)
    values = [(int(c), int(t), float(k)) for k, (c, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 50, 200)))]
    rows = spark.createDataFrame(values, "c int, t int, v double")
    got = {r["v"]: (r["prev"] and r["prev"]["v"], r["next"] and r["next"]["v"]) for r in neighbours(rows, "c", ["t", "v"], ["v"]).collect()}
    for c in range(3):
        line = [v for _, t, v in sorted((x for x in values if x[0] == c), key=lambda x: (x[1], x[2]))]
        for k, v in enumerate(line):
            assert got[v] == (line[k - 1] if k else None, line[k + 1] if k + 1 < len(line) else None)


def test_neighbours_of_one_key_over_many_ranges(spark):
    """Nearly all rows have one key: they are spread over ranges of like size."""
    import pandas as pd

    rng = np.random.default_rng(9)
    table = pd.DataFrame({"c": np.where(np.arange(20000) % 100 == 7, "rare", "hot"), "t": rng.integers(0, 5000, 20000), "v": np.arange(20000.0)})
    rows = spark.createDataFrame(table)
    got = neighbours(rows, "c", ["t", "v"], ["v"]).select("v", F.col("prev.v").alias("prev"), F.col("next.v").alias("next")).toPandas().sort_values("v")
    line = table.sort_values(["c", "t", "v"])
    line["prev"], line["next"] = line.groupby("c")["v"].shift(1), line.groupby("c")["v"].shift(-1)
    line = line.sort_values("v")
    assert np.array_equal(got["prev"], line["prev"], equal_nan=True) and np.array_equal(got["next"], line["next"], equal_nan=True)


def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")


@pytest.fixture
def ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    many_ranges(spark)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranks_of_a_heavy_key_over_many_ranges(spark, ranges):
    import pandas as pd

    from tidemark.functions.ranks import dealt

    rng = np.random.default_rng(11)
    table = pd.DataFrame({"m": np.where(np.arange(60000) < 59000, "hot", "rare"), "v": rng.normal(size=60000).round(3)})
    counts = spark.createDataFrame(table).groupBy("m", "v").agg(F.count("*").alias("n"))
    got = average_ranks(counts, ["m"], "v").toPandas().set_index(["m", "v"])["rank"]
    assert np.allclose(table.groupby("m")["v"].rank(), [got[key] for key in zip(table["m"], table["v"])])
    sizes = [r["count"] for r in dealt(spark.createDataFrame(table), "m", "v").groupBy("__range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * np.mean(sizes)


def test_quantiles_equal_percentile(spark, ranges):
    from tidemark.functions.ranks import quantiles

    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(None if k % 9 == 0 else f"g{k % 4}", float(v)) for k, v in enumerate(rng.integers(0, 500, 3000))] + [("one", 5.0)], "g string, v double")
    fractions = [0.0, 0.25, 0.333, 0.5, 0.995, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(rows.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v", fractions).collect()}
    for r in rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, fractions))).alias("q")).collect():
        assert np.allclose(r["q"], got[r["g"]])
    whole = quantiles(rows.groupBy("v").agg(F.count("*").alias("n")), [], "v", [0.5]).collect()
    assert [r["q"][0] for r in whole] == [rows.agg(F.median("v")).first()[0]]


def test_positions(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 3).withColumn("v", (F.col("id") * 37) % 101)
    for g, part in positions(rows, ["g"], F.expr("v div 10"), ["v"], "p").toPandas().groupby("g"):
        assert list(part.sort_values("v")["p"]) == list(range(1, len(part) + 1))


def test_ranks_and_holm(spark):
    counts = spark.createDataFrame([("m", 1.0, 1), ("m", 2.0, 2), ("m", 3.0, 1)], "metric string, value double, n long")
    assert [r["rank"] for r in average_ranks(counts, ["metric"], "value").orderBy("value").collect()] == [1.0, 2.5, 4.0]
    tests = spark.createDataFrame([("a", "f", 0.01), ("b", "f", 0.04), ("c", "f", 0.03)], "k string, f string, p double")
    assert [round(r["p_holm"], 10) for r in stats.holm(tests, ["f"], ["k"]).orderBy("k").collect()] == [0.03, 0.06, 0.06]


def test_erfc(spark):
    xs = [0.0, 0.3, 1.0, 2.5, 4.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] / math.erfc(x) - 1) < 2e-7 for r, x in zip(rows, xs))
    small = spark.createDataFrame([(0.9, 3.0)], "r double, n double").select(correlation_p(F.col("r"), F.col("n")).alias("p")).first()
    assert small["p"] == 1.0


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, 300), rng.integers(0, 30, 300)
    layer = canon(spark, [{"traffic_volume": int(a), "road_incidents": int(b), "citizen_complaints": 5} for a, b in zip(x, y)])
    pair = [("traffic_volume", "road_incidents")]
    assert abs(stats.pearson_pairs(layer, pairs=pair).first()["r"] - np.corrcoef(x, y)[0, 1]) < 1e-9

    def ranks(v):
        return np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])

    assert abs(stats.spearman_pairs(layer, pairs=pair).first()["r"] - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-9
    assert stats.pearson_pairs(layer, pairs=[("traffic_volume", "citizen_complaints")]).first()["r"] == 0.0


def test_gram_sums_against_numpy(spark):
    rng = np.random.default_rng(6)
    data = [[None if rng.random() < 0.2 else float(rng.integers(0, 50)) for _ in METRICS] for _ in range(200)]
    rows = spark.createDataFrame([("a" if k % 3 else None, *r) for k, r in enumerate(data)], "g string, " + ", ".join(f"{m} double" for m in METRICS)).repartition(5)
    got = {(r["g"], r["x"], r["y"]): (r["n"], r["r"]) for r in stats.gram(rows, ["g"]).select("g", "x", "y", "n", stats.gram_correlation().alias("r")).collect()}
    assert len(got) == 72
    for g, keep in (("a", [k for k in range(200) if k % 3]), (None, list(range(0, 200, 3)))):
        table = np.array([[np.nan if v is None else v for v in data[k]] for k in keep])
        for (h, x, y), (n, r) in got.items():
            if h == g:
                a, b = table[:, METRICS.index(x)], table[:, METRICS.index(y)]
                both = ~np.isnan(a) & ~np.isnan(b)
                assert n == both.sum() and abs(r - np.corrcoef(a[both], b[both])[0, 1]) < 1e-9


def test_eta_squared(spark):
    for cities, expected in (("aabb", 1.0), ("abab", 0.0)):
        layer = canon(spark, [{"city": c, "traffic_volume": v} for c, v in zip(cities, (1, 1, 3, 3))])
        row = stats.eta_squared(stats.group_sums(layer)).filter("factor = 'city' AND metric = 'traffic_volume'").first()
        assert abs(row["eta2"] - expected) < 1e-12


def test_quantiles_and_single_row(spark):
    row = stats.metric_summary(canon(spark, [{"traffic_volume": v} for v in (1, 2, 3, 4)])).filter("metric = 'traffic_volume'").first()
    assert (row["q1"], row["median"], row["q3"]) == (1.75, 2.5, 3.25)
    assert stats.metric_summary(canon(spark, [{}])).filter("metric = 'traffic_volume'").first()["sd"] is None


def test_imputation(spark):
    values = [None, 1, 1, 1, 1, 50]
    zones = ["b", "a", "a", "b", None, ""]
    layer = canon(spark, [{"traffic_volume": v, "zone": z} for v, z in zip(values, zones)]).withColumn("probable_error", F.lit(False))
    methods = {r["field"]: r for r in scenarios.imputation_methods(layer).collect()}
    assert methods["traffic_volume"]["method"] == "median" and methods["traffic_volume"]["estimate"] == 1.0
    assert methods["avg_speed_kmph"]["method"] == "mean"
    assert methods["zone"]["label"] == "A"
    done = scenarios.imputed_layer(layer, scenarios.imputation_methods(layer))
    assert done.filter("traffic_volume IS NULL OR zone IS NULL").count() == 0
    assert done.agg(F.sum("imputation_count")).first()[0] == 3


def test_empty_selection_keeps_schema(spark):
    layer = canon(spark, [{}])
    assert api.filtered(layer, api.Selection()).count() == 1
    none = api.filtered(layer, api.Selection(cities=("nowhere",)))
    assert none.count() == 0 and none.columns == api.frame(layer).columns
    assert api.period_means(none, "month", ["traffic_volume"]).count() == 0


def test_append_one_row(spark):
    table = raw(spark, [{}, {}])
    more = table.unionByName(raw(spark, [{"record_id": "NEW"}]))
    before, after = (layers.canonical(layers.dedup_exact(t)) for t in (table, more))
    assert after.count() == before.count() + 1 and layers.primary(after).count() == layers.primary(before).count() + 1


def test_refresh_is_versioned(spark, tmp_path):
    path = str(tmp_path / "layers")
    sources.refresh({"raw": spark.range(2).toDF("x")}, path, "v1")
    sources.refresh({"raw": spark.range(3).toDF("x")}, path, "v2")
    assert sources.current(spark, path, "raw").count() == 3
    assert sources.fingerprint(spark, path + "/data/*/raw/*.parquet").filter("length(sha256) = 64").count() > 0


class Killed(RuntimeError):
    pass


@pytest.mark.parametrize("step", ["second layer", "before the manifest", "empty manifest", "torn manifest"])
def test_a_writer_that_dies_leaves_the_last_refresh(spark, tmp_path, monkeypatch, step):
    from tidemark.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    one, two = {n: spark.range(2).toDF("x") for n in ("raw", "clean")}, {n: spark.range(5).toDF("x") for n in ("raw", "clean")}
    store.refresh(one, "v1")
    with monkeypatch.context() as patched:
        real_write, real_create, real_fill = store.write, store.create, store.fill

        def write(df, below):
            if step == "second layer" and below.endswith("clean"):
                raise Killed
            real_write(df, below)

        def create(number):
            if step == "before the manifest":
                raise Killed
            return real_create(number)

        def fill(stream, text):
            if step == "empty manifest":
                stream.close()
                raise Killed
            if step == "torn manifest":
                real_fill(stream, text[: len(text) // 2])
                raise Killed
            real_fill(stream, text)

        for name, made in (("write", write), ("create", create), ("fill", fill)):
            patched.setattr(store, name, made)
        with pytest.raises(Killed):
            store.refresh(two, "v2")
    assert store.current()["label"] == "v1" and store.layer("raw").count() == store.layer("clean").count() == 2
    assert store.recover() and store.layer("clean").count() == 2
    left = {d.name for d in (tmp_path / "store" / "data").iterdir()}
    assert left == {p.split("/")[1] for p in store.current()["layers"].values()}
    store.refresh(two, "v3")
    assert store.current()["label"] == "v3" and store.layer("raw").count() == 5


def test_a_reader_in_a_loop_never_fails(spark, tmp_path):
    import threading

    from tidemark.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    store.refresh({"a": spark.range(1).toDF("x"), "b": spark.range(1).toDF("x")}, "0")
    stop, seen, failed = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                manifest = store.current()
                pair = (store.layer("a", manifest).count(), store.layer("b", manifest).count())
                seen.append(pair)
                assert pair[0] == pair[1]
            except Exception as error:  # the test reports it
                failed.append(error)
                return

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 5):
        store.refresh({n: spark.range(k + 1).toDF("x") for n in ("a", "b")}, str(k))
    stop.set()
    reader.join()
    assert not failed and seen and store.layer("a").count() == 5


def test_two_writers_of_one_number(spark, tmp_path):
    from tidemark.sources.store import Store

    store, other = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    first = store.create(1)
    assert first is not None and other.create(1) is None
    assert other.publish("later", {})["number"] == 2
    store.fill(first, '{"number": 1, "label": "earlier", "layers": {}}\nend\n')
    assert store.current()["label"] == "later"


def test_fingerprint_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    import hashlib

    name = tmp_path / "large file.bin"
    with name.open("wb") as out:
        out.truncate((2 << 30) + 12345)  # sparse
    (tmp_path / "small.bin").write_bytes(b"abc")
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["bytes"], r["sha256"]) for r in sources.fingerprint(spark, str(tmp_path)).collect()}
    expected = hashlib.sha256()
    for _ in range(2 << 10):
        expected.update(bytes(1 << 20))
    expected.update(bytes(12345))
    assert got == {"large file.bin": ((2 << 30) + 12345, expected.hexdigest()), "small.bin": (3, hashlib.sha256(b"abc").hexdigest())}


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.refresh import refresh_each

    source, store = str(tmp_path / "in"), str(tmp_path / "raw")
    raw(spark, [{}, {}]).write.parquet(source)
    seen = []
    for extra in ([], [{"record_id": "NEW"}]):
        if extra:
            raw(spark, extra).write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw(spark, [{}]).schema).parquet(source)
        refresh_each(stream, store, str(tmp_path / "state"), lambda rows: seen.append(layers.dedup_exact(rows).count())).start().awaitTermination()
    assert seen[-1] == 3


def test_models_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.integers(0, 100, n).astype(float)
    y = 3 + 0.5 * x + rng.normal(0, 2, n)
    y[:10] += 200
    counts = rng.poisson(np.exp(0.2 + 0.01 * x))
    X = np.stack([np.ones(n), x / 10], axis=1)
    rows = spark.createDataFrame([(float(a), float(b), float(c), f"d{k % 20}") for k, (a, b, c) in enumerate(zip(x, y, counts))], "x0 double, y0 double, c0 double, observation_date string")
    xy = rows.select("observation_date", F.col("y0").alias("y"), F.array(F.lit(1.0), F.col("x0") / 10).alias("x")).persist()
    w = np.ones(n)
    for _ in range(60):
        beta = np.linalg.solve((X * w[:, None]).T @ X, (X * w[:, None]).T @ y)
        r = y - X @ beta
        w = models.huber_weights(r, 1.4826 * np.median(np.abs(r - np.median(r))))
    fit = models.huber(xy, 2)
    assert np.allclose(fit.beta, beta, rtol=1e-2) and abs(fit.beta[1] - 5) < 0.2
    ridge = models.ridge(xy, 2)
    assert np.allclose(ridge, np.linalg.solve(X.T @ X + np.diag([0.0, 1.0]), X.T @ y))
    draws = models.block_bootstrap(xy, fit, 2, 30)
    low, high = models.interval(draws[:, 1])
    assert low < fit.beta[1] < high
    counted = rows.select("observation_date", F.col("c0").alias("y"), F.array(F.lit(1.0), F.col("x0") / 10).alias("x"))
    poisson = models.glm(counted, 2, "poisson")
    b = np.zeros(2)
    for _ in range(50):
        mu = np.exp(X @ b)
        b = b + np.linalg.solve((X * mu[:, None]).T @ X, X.T @ (counts - mu))
    assert np.allclose(poisson.beta, b, atol=1e-4) and poisson.dispersion < 1.5
    assert models.count_model(counted, 2).family == "poisson"


def test_ridge_forecast_against_numpy(spark):
    rng = np.random.default_rng(3)
    begin = dt.datetime(2026, 1, 1)
    made = [{"city": "Pune" if k % 3 else "Delhi", "traffic_volume": int(100 + 20 * (k % 6) + rng.integers(0, 9)), "timestamp_text": str(begin + dt.timedelta(hours=4 * k))} for k in range(72)]
    layer = canon(spark, made).withColumn("probable_error", F.lit(False))
    rows = models.analysis_rows(layer).toPandas().sort_values(["ts", "record_id"]).reset_index(drop=True)
    y = rows["traffic_volume"].to_numpy(float)
    columns = [np.ones(len(rows))]
    for factor in ("city", "zone", "month", "hour", "weekday"):
        columns += [(rows[factor] == level).to_numpy(float) for level in sorted(rows[factor].unique())[1:]]
    X = np.stack(columns, axis=1)
    penalty = np.diag([0.0] + [1.0] * (X.shape[1] - 1))
    found = models.ridge_forecast(layer, ["traffic_volume"]).orderBy("fold").collect()
    assert [r["fold"] for r in found] == [1, 2, 3]
    for r, (_, a, b) in zip(found, FOLDS):
        cut, end = int(72 * a), int(72 * b)
        beta = np.linalg.solve(X[:cut].T @ X[:cut] + penalty, X[:cut].T @ y[:cut])
        error = y[cut:end] - X[cut:end] @ beta
        known = rows[:cut].groupby(["city", "month"])["traffic_volume"].median()
        base = np.array([known[(c, m)] for c, m in zip(rows["city"][cut:end], rows["month"][cut:end])])
        assert r["test_n"] == end - cut
        assert np.isclose(r["model_mae"], np.abs(error).mean()) and np.isclose(r["baseline_mae"], np.abs(y[cut:end] - base).mean())
        assert np.isclose(r["r2"], 1 - (error**2).sum() / ((y[cut:end] - y[cut:end].mean()) ** 2).sum())
        assert r["useful"] == (r["improvement"] >= 0.1 and r["r2"] >= 0.1)


def test_lagged_forecast_of_few_rows_is_empty(spark):
    layer = canon(spark, [{}, {}]).withColumn("probable_error", F.lit(False))
    none = models.lagged_forecast(layer, ["traffic_volume"], replicates=5)
    assert none.count() == 0 and none.columns[-4:] == ["improvement_low", "improvement_high", "r2_low", "r2_high"]


def test_permutation_p_is_small_for_an_effect(spark):
    layer = canon(spark, [{"city": c, "traffic_volume": v} for c, v in zip("aaaaaabbbbbb", (1, 2, 1, 2, 1, 2, 9, 8, 9, 8, 9, 8))])
    row = stats.permutation_eta(layer, "city", 99, metrics=["traffic_volume"]).first()
    assert row["eta2"] > 0.9 and row["p"] <= 0.05


def test_bootstrap_interval_holds_the_mean(spark):
    values = spark.createDataFrame([("m", f"r{k}", float(k % 10)) for k in range(500)], "metric string, record_id string, value double")
    row = stats.bootstrap_mean(values, ["metric"], 100).first()
    assert row["ci_low"] < row["mean"] == 4.5 < row["ci_high"]


REPLICATED = {"permutation_tests": 5000, "bootstrap_means": 5000, "group_gates": 5000, "diagnostics": 5000, "relationship_effects": 3000, "group_effects": 3000, "lagged_forecast": 3000}


def test_registered_replicates(monkeypatch):
    from types import SimpleNamespace

    from tidemark.operators import provenance
    from tidemark.plans import catalog

    asked = {}

    def ask(name):
        def made(*args, **given):
            asked[name] = next((v for v in [*args, given.get("replicates")] if isinstance(v, int) and v > 0), None)
            return SimpleNamespace(drop=lambda *names: None)

        return made

    monkeypatch.setattr(catalog, "rounded", lambda df: df)
    monkeypatch.setattr(stats, "long_values", lambda *args: None)
    for name in REPLICATED:
        module = next(m for m in (resample, stats, models, provenance) if hasattr(m, name))
        monkeypatch.setattr(module, name, ask(name))
    for name in REPLICATED:
        query = {"diagnostics": "provenance_diagnostics", "permutation_tests": "permutation_eta", "bootstrap_means": "bootstrap_mean"}.get(name, name)
        catalog._OF_TABLES[query](SimpleNamespace(marked=None, layer=None))
    assert asked == REPLICATED


def test_blocks_of_replicates_change_nothing(spark, monkeypatch):
    from tidemark.functions import ranks

    assert ranks.replicate_blocks(ranks.BLOCK_ROWS, 3) == [(1, 1), (2, 2), (3, 3)] and ranks.replicate_blocks(0, 3) == [(1, 3)]
    layer = canon(spark, [{"city": c, "traffic_volume": v} for c, v in zip("aabbab", (1, 2, 3, 2, 1, 5))])
    one = stats.permutation_eta(layer, "city", 7, metrics=["traffic_volume"]).collect()
    monkeypatch.setattr(ranks, "BLOCK_ROWS", 20)
    assert stats.permutation_eta(layer, "city", 7, metrics=["traffic_volume"]).collect() == one


def test_deals_by_counts_and_by_shuffling_agree():
    """Both ways of dealing against the exact distribution of a small case."""
    from itertools import permutations

    values, n, sizes = np.array([1.0, 5.0, 9.0]), np.array([3, 2, 2]), np.array([3, 4])
    between = lambda draw, n, sizes: np.array([(resample.dealt_sums(draw, values, n, sizes) ** 2 / sizes).sum() for _ in range(4000)])
    rows = np.repeat(values, n)
    exact = np.array([(sum(p[:3]) ** 2 / 3 + sum(p[3:]) ** 2 / 4) for p in permutations(rows.tolist())])
    shuffled = between(resample.generator(1), n, sizes)
    assert abs(shuffled.mean() - exact.mean()) < 0.05 * exact.std() and abs(shuffled.std() - exact.std()) < 0.05 * exact.std()
    many = n * 200  # now drawn by counts: mean and spread of a deal are known
    drawn = between(resample.generator(2), many, sizes * 200)
    rows = np.repeat(values, many)
    total, k = len(rows), 600
    spread = rows.var() * total / (total - 1)
    chi = (drawn - rows.sum() ** 2 / total) / spread  # about chi-squared with one degree of freedom
    assert abs(chi.mean() - 1) < 0.1 and abs(chi.var() - 2) < 0.5 and k == sizes[0] * 200


def test_draws_beyond_a_billion_rows():
    colors = np.array([3_000_000_000, 5, 2_000_000_000, 1_000_000])
    drawn = np.array([resample.some_of_each(resample.generator(4, r), colors, 1_000_000_000) for r in range(500)])
    assert (drawn.sum(axis=1) == 1_000_000_000).all() and (drawn <= colors).all() and (drawn >= 0).all()
    assert np.allclose(drawn.mean(axis=0)[[0, 2, 3]], (colors / colors.sum() * 1e9)[[0, 2, 3]], rtol=1e-3) and 0.5 < drawn[:, 1].mean() < 1.5


def test_shares_of_chunks_fit_together():
    """All chunks of a replicate deal out every place once, as one deal would."""
    totals, sizes = np.array([5, 1, 7, 4, 3]), np.array([6, 10, 4])
    seen = np.zeros((3000, 5, 3))
    for r in range(3000):
        seen[r] = [resample.shares(3, ("f", "m"), r, totals, sizes, c) for c in range(5)]
    assert (seen.sum(axis=2) == totals).all() and (seen.sum(axis=1) == sizes).all()
    expected = np.outer(totals, sizes) / 20
    variance = expected * (1 - sizes / 20) * (20 - totals[:, None]) / 19
    assert np.allclose(seen.mean(axis=0), expected, atol=0.1) and np.allclose(seen.var(axis=0), variance, rtol=0.15)


def test_permutation_tests_over_many_chunks(spark, monkeypatch):
    """Continuous values in many chunks give the p of one chunk, within its error."""
    rng = np.random.default_rng(10)
    rows = [{"city": "abc"[k % 3], "temperature_c": float(rng.normal() + 0.25 * (k % 3 == 0)), "record_id": f"R{k:04d}"} for k in range(300)]
    layer = canon(spark, rows)
    one = resample.permutation_tests(layer, ["city"], 2000, metrics=["temperature_c"]).first()
    monkeypatch.setattr(resample, "CHUNK", 11)
    many = resample.permutation_tests(layer, ["city"], 2000, metrics=["temperature_c"]).first()
    again = resample.permutation_tests(layer.repartition(9), ["city"], 2000, metrics=["temperature_c"]).first()
    assert many["p"] == again["p"] and one["eta2"] == pytest.approx(many["eta2"]) == again["eta2"] and abs(one["p"] - many["p"]) < 4 * math.sqrt(one["p"] * (1 - one["p"]) / 1000) + 0.005


def test_group_gates_find_a_planted_effect_and_no_other(spark):
    """With the replicates of the registered query the gate can be passed."""
    rng = np.random.default_rng(4)
    rows = [{"city": c, "zone": z, "traffic_volume": int(100 + 40 * (c == "Pune") + rng.integers(0, 60)), "road_incidents": int(rng.integers(0, 9))} for c in ("Pune", "Delhi") for z in ("North", "South") for _ in range(60)]
    layer = canon(spark, rows).withColumn("probable_error", F.lit(False))
    found = {(r["factor"], r["metric"]): r for r in stats.group_gates(layer, 5000).collect()}
    assert found["city", "traffic_volume"]["supported"] and found["city", "traffic_volume"]["p_holm"] < 0.01
    assert not found["city", "road_incidents"]["supported"] and not found["zone", "traffic_volume"]["supported"]
    plain = {r["metric"]: r["eta2"] for r in stats.permutation_eta(layer, "city", 1, metrics=["traffic_volume", "road_incidents"]).collect()}
    assert all(math.isclose(plain[m], found["city", m]["eta2"], rel_tol=1e-9) for m in plain)


def test_bootstrap_by_counts_holds_the_mean(spark):
    values = spark.createDataFrame([("m", float(k % 10)) for k in range(500)], "metric string, value double")
    row = resample.bootstrap_means(values, ["metric"], 3000).first()
    half = 2.576 * np.std(np.arange(10)) / math.sqrt(500)
    assert row["n"] == 500 and row["mean"] == 4.5 and abs(row["ci_low"] - 4.5 + half) < 0.05 and abs(row["ci_high"] - 4.5 - half) < 0.05


def null_fixture(spark):
    rng = np.random.default_rng(8)
    rows = [{"city": ["Pune", "Delhi", "Goa"][k % 3], "zone": ["North", "South", ""][k % 7 % 3], "traffic_volume": int(rng.integers(0, 50)), "road_incidents": None if k % 5 == 0 else int(rng.integers(0, 5)), "temperature_c": float(rng.normal()), "timestamp_text": str(dt.datetime(2026, 1, 1) + dt.timedelta(hours=4 * k))} for k in range(150)]
    return canon(spark, rows + [{"city": "Lonely", "record_id": "L"}])


def test_null_is_the_same_for_any_leaves_and_partitions(spark, monkeypatch):
    """Nothing depends on how rows, values and replicates are cut."""
    from tidemark.operators import provenance

    layer = null_fixture(spark)
    key = lambda r: (r["rep"], r["category"], r["variable_x"], r["variable_y"] or "", r["grouping"] or "")

    def run(layer):
        return {key(r): r["value"] for r in provenance.simulated(layer, provenance.observed_values(layer), 12).collect()}

    whole = run(layer)
    assert len(whole) == 12 * 63
    for name, size in (("LEAF", 17), ("CHUNK", 20), ("BLOCK", 5)):
        monkeypatch.setattr(provenance, name, size)
    parts = run(layer.repartition(7))
    assert parts.keys() == whole.keys() and all(math.isclose(parts[k], whole[k], rel_tol=1e-9, abs_tol=1e-9) for k in whole)


def test_null_agrees_with_permutations_by_numpy(spark):
    """Means and spreads of the replicates against shuffles of the same rows."""
    import pandas as pd

    from tidemark.operators import provenance

    layer = null_fixture(spark)
    found = {}
    for r in provenance.simulated(layer, provenance.observed_values(layer), 1500).collect():
        found.setdefault((r["category"], r["variable_x"], r["variable_y"], r["grouping"]), []).append(r["value"])
    table = layer.toPandas().sort_values(["city", "ts", "record_id"]).reset_index(drop=True)
    rng = np.random.default_rng(3)
    columns = {m: table[m].astype(float) for m in ("traffic_volume", "road_incidents", "temperature_c")}

    def shuffled(m, ranks):
        have = columns[m].notna().to_numpy()
        out = columns[m].copy()
        out[have] = rng.permutation(columns[m].rank()[have] if ranks else columns[m][have])
        return out

    drawn = {"pair": [], "eta": [], "lag": []}
    for _ in range(1500):
        a, b = shuffled("traffic_volume", True), shuffled("road_incidents", True)
        both = a.notna() & b.notna()
        drawn["pair"].append(abs(np.corrcoef(a[both], b[both])[0, 1]))
        v = shuffled("road_incidents", False)
        one = pd.DataFrame({"g": table["city"], "v": v}).dropna()
        centre = one["v"].mean()
        drawn["eta"].append(sum(len(p) * (p.mean() - centre) ** 2 for _, p in one.groupby("g")["v"]) / ((one["v"] - centre) ** 2).sum())
        t = shuffled("temperature_c", False)
        before = t.groupby(table["city"]).shift(1)
        keep = before.notna() & (table["city"] != "Lonely")
        drawn["lag"].append(np.corrcoef(before[keep], t[keep])[0, 1])
    keys = {"pair": ("pairwise_abs_spearman", "traffic_volume", "road_incidents", None), "eta": ("group_alignment_eta_squared", "road_incidents", None, "city"), "lag": ("within_city_lag1_autocorrelation", "temperature_c", None, "city")}
    for name, key in keys.items():
        x, y = np.array(found[key]), np.array(drawn[name])
        assert abs(x.mean() - y.mean()) < 5 * y.std() / math.sqrt(750) and abs(x.std() / y.std() - 1) < 0.1, name


def test_dealt_places_are_a_permutation():
    from tidemark.operators import provenance

    for n in (1, 2, 3, 10, 97, 1000):
        for r in range(3):
            assert sorted(provenance.dealt_place(np.arange(n), n, 5, 2, r).tolist()) == list(range(n))
    # two places go to every pair of places about as often
    seen = np.zeros((5, 5))
    for r in range(4000):
        a, b = provenance.dealt_place(np.arange(2), 5, 1, 0, r)
        seen[a, b] += 1
    assert np.trace(seen) == 0 and abs(seen[~np.eye(5, dtype=bool)] / 200 - 1).max() < 0.3


def test_block_bootstrap_against_numpy_with_many_replicates(spark):
    rng = np.random.default_rng(2)
    x, day = rng.normal(size=60), [f"d{k % 6}" for k in range(60)]
    y = 2 + 3 * x + rng.normal(size=60)
    rows = spark.createDataFrame([(float(a), float(b), d) for a, b, d in zip(x, y, day)], "x0 double, y double, observation_date string")
    xy = rows.select("observation_date", "y", F.array(F.lit(1.0), "x0").alias("x")).repartition(3)
    fit = models.Fit("huber", np.array([2.0, 3.0]), 1.0)
    found = models.block_bootstrap(xy, fit, 2, 3000, 7)
    X = np.stack([np.ones(60), x], axis=1)
    weights = {d: resample.generator(7, d).poisson(1.0, 3000) for d in set(day)}
    for r in (0, 1, 1499, 2999):
        w = models.huber_weights(y - X @ fit.beta, 1.0) * np.array([weights[d][r] for d in day])
        assert np.allclose(found[r], models.solve(models._moments(X, w, y), 2))
    assert found.shape == (3000, 2)


def test_marginal_means_against_setting_every_row(spark):
    rng = np.random.default_rng(1)
    rows = [{"city": rng.choice(["a", "b", "c"]), "zone": rng.choice(["North", "South"]), "traffic_volume": int(k % 7)} for k in range(50)]
    layer = models.analysis_rows(canon(spark, rows).withColumn("probable_error", F.lit(False)))
    d = models.design(layer)
    xy = models.matrix(layer, d, "traffic_volume")
    X = np.array([r["x"] for r in xy.collect()])
    betas = rng.normal(0, 0.1, (4, len(d.names)))
    for log_link in (False, True):
        for level, got in models.marginal_means(xy, d, "city", betas, log_link).items():
            fixed = X.copy()
            for j, name in enumerate(d.names):
                if name.startswith("city="):
                    fixed[:, j] = name == f"city={level}"
            eta = fixed @ betas.T
            assert np.allclose(got, (np.exp(eta) if log_link else eta).mean(axis=0))


@pytest.mark.parametrize("name", ["ridge_forecast", "group_effects", "lagged_forecast"])
def test_registered_for_all_metrics(monkeypatch, name):
    import inspect
    from types import SimpleNamespace

    from tidemark.plans import catalog

    signature, asked = inspect.signature(getattr(models, name)), []

    def made(*args, **given):
        bound = signature.bind(*args, **given)
        bound.apply_defaults()
        asked.append(bound.arguments["metrics"])

    monkeypatch.setattr(catalog, "rounded", lambda df: df)
    monkeypatch.setattr(models, name, made)
    catalog._OF_TABLES[name](SimpleNamespace(marked=None))
    assert asked == [METRICS] and len(METRICS) == 9


def test_flags_are_refreshed_by_prefix(spark):
    old = spark.createDataFrame([("a", "zone", "imputed", "imputed for sensitivity: old", "x"), ("b", "zone", "missing", None, "x"), ("c", "zone", "outlier", "else", "x")], "record_id string, field_name string, flag_type string, reason string, effect string")
    new = old.filter("record_id = 'a'").withColumn("reason", F.lit("imputed for sensitivity: new"))
    once = quality.refreshed_flags(old, new, quality.IMPUTED_PREFIX)
    twice = quality.refreshed_flags(once, new, quality.IMPUTED_PREFIX)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect())) and {r["reason"] for r in twice.collect()} == {None, "else", "imputed for sensitivity: new"}


def test_upsert_takes_the_last_of_a_key(spark):
    base = spark.createDataFrame([("k", 1, "old"), ("l", 1, "kept")], "key string, version int, value string")
    new = spark.createDataFrame([("k", 3, "a"), ("k", 2, "z"), ("m", 1, "b")], "key string, version int, value string")
    got = {r["key"]: r["value"] for r in sources.upsert(base, new, ["key"], ["version"]).collect()}
    assert got == {"k": "a", "l": "kept", "m": "b"}


def test_latest_run(spark):
    from tidemark.operators import governance

    runs = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "stage string, run int")
    assert governance.latest(runs, ["run"]).collect() == [("a", 3)]
    assert sorted(map(tuple, governance.latest(runs, ["run"], ["stage"]).collect())) == [("a", 3), ("b", 2)]
    assert governance.latest(runs.filter("run > 9"), ["run"]).count() == 0


def test_issues_hold_raw_and_suggested_values(spark):
    layer = canon(spark, [{"zone": "NORTH", "avg_speed_kmph": 150.0}])
    got = {r["issue_type"]: (r["raw_value"], r["suggested_value"], r["treatment"]) for r in quality.quality_issues(layer).collect() if r["issue_type"] != "missing"}
    assert got == {"case_variant": ("NORTH", "North", "canonicalize_case_only"), "extreme_value": ("150.0", None, "retain_flag_exclude_primary_analysis")}


def test_stream_upkeeps_a_summary(spark, tmp_path):
    from tidemark.sources.store import Store
    from tidemark.streaming.refresh import summary_each

    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    summarise = lambda rows: rows.groupBy("city").agg(F.count("*").alias("rows"))
    for cities in (["Pune", "Pune", "Goa"], ["Goa"], []):
        if cities:
            raw(spark, [{"city": c} for c in cities]).write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw(spark, [{}]).schema).parquet(source)
        summary_each(stream, store, str(tmp_path / "state"), summarise, ["city"], "rows").start().awaitTermination()
    assert sorted(map(tuple, store.layer("summary").collect())) == [("Goa", 2), ("Pune", 2)]
    label = store.current()["label"]
    # the same batches again, as after a lost checkpoint, are known by their numbers
    summary_each(spark.readStream.schema(raw(spark, [{}]).schema).parquet(source), store, str(tmp_path / "other"), summarise, ["city"], "rows").start().awaitTermination()
    assert store.current()["label"] == label and sorted(map(tuple, store.layer("summary").collect())) == [("Goa", 2), ("Pune", 2)]


def test_flag_summary_by_deltas_equals_a_rebuild(spark):
    """Random refreshes: flags come and go, and the upkept summary follows."""
    rng = np.random.default_rng(7)
    schema = "flag_type string, field_name string, k int"
    make = lambda n: [(str(rng.choice(["missing", "outlier"])), str(rng.choice(["zone", "speed", "temp"])), int(k)) for k in rng.integers(0, 5, n)]
    flags = make(30)
    summary = quality.flag_summary(spark.createDataFrame(flags, schema))
    for _ in range(4):
        gone = [flags.pop(int(rng.integers(0, len(flags)))) for _ in range(int(rng.integers(0, len(flags))))]
        new = make(int(rng.integers(0, 10)))
        flags += new
        delta = quality.flag_delta(spark.createDataFrame(gone, schema), spark.createDataFrame(new, schema))
        summary = spark.createDataFrame(quality.with_delta(summary, delta).collect(), "flag_type string, field_name string, flags long")
        assert sorted(map(tuple, summary.collect())) == sorted(map(tuple, quality.flag_summary(spark.createDataFrame(flags, schema)).collect()))


def test_a_quote_in_a_parameter_is_data(spark):
    layer = canon(spark, [{"city": "O'Hara"}, {"city": "x' OR '1'='1"}, {"city": "Pune"}])
    picked = lambda **how: sorted(r["city"] for r in api.filtered_sql(layer, api.Selection(**how)).collect())
    assert picked(cities=("O'Hara",)) == ["O'Hara"] and picked(cities=("x' OR '1'='1", ":p0")) == ["x' OR '1'='1"]
    assert len(picked()) == len(picked(cities=(), hours=())) == 3 and picked(zones=("Nowhere",)) == []
    for choice in (api.Selection(cities=("Pune",), hours=(0,), start="2025-12-31", end="2026-01-01", primary_only=True), api.Selection(start="2026-01-02")):
        assert sorted(api.filtered_sql(layer, choice).collect()) == sorted(api.filtered(layer, choice).collect())


def test_runs_and_contracts_in_the_store(spark, tmp_path):
    from tidemark.operators import governance
    from tidemark.sources.store import NoManifest, Store

    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(NoManifest):
        store.current()
    governance.record_run(store, {"raw": spark.range(3), "canonical": spark.range(2)})
    governance.record_run(store, {"raw": spark.range(5)}, ("models",))
    rows = {r["contract_key"]: (r["status"], r["run"], r["rows"]) for r in governance.current_contracts(store).collect()}
    assert rows["provenance"] == ("protocol_registered", 2, 5) and rows["models"] == ("completed", 1, 2) and rows["quality_decisions"][1:] == (None, None)


def test_texts_for_readers(spark, tmp_path):
    table = spark.createDataFrame([("a|b", 1234.5), (None, None), ("line\nbreak", 2.0)], "name string, x double")
    assert api.markdown(table).split("\n")[2:] == ["| a\\|b | 1234.5 |", "|  |  |", "| line break | 2.0 |"]
    assert api.markdown(table, 1).split("\n")[-1] == "2 more rows are not shown."
    assert [r[0] for r in table.select(api.display(F.col("x"))).collect()] == ["1,234.50", "n.a.", "2.00"]
    sources.write_csv(table, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv"))
    assert {r["name"] for r in back.collect()} == {"a|b", None, "line\nbreak"}


def test_weather_documents(spark):
    text = '{"t2m_max": {"20260101": 31.5, "20260102": -999.0}, "t2m_min": {"20260101": 12.0}}'
    rows = sources.readings_from_json(spark.createDataFrame([(text,), ("broken",), (None,)], "j string"), "j").collect()
    assert sorted(map(tuple, rows)) == [("t2m_max", "20260101", 31.5), ("t2m_min", "20260101", 12.0)]


def test_run_log_is_json(spark):
    import json

    from tidemark.operators import governance

    row = governance.run_log(spark, "refresh", {"rows": 5, "note": 'a "b"'}).first()
    assert row["stage"] == "refresh" and json.loads(row["details_json"]) == {"rows": 5, "note": 'a "b"'} and row["ended_at"] is not None


def test_stacked_fits_against_numpy(spark):
    """All folds of a count and a real metric together, against one at a time."""
    from tidemark.operators import stacked

    rng = np.random.default_rng(3)
    begin = dt.datetime(2026, 1, 1)
    made = [{"record_id": f"R{k:04d}", "city": ["Pune", "Delhi"][int(rng.integers(0, 2))], "temperature_c": float(20 + 3 * (k % 6) + rng.standard_t(2)), "road_incidents": int(rng.poisson(3 + k % 4)), "timestamp_text": str(begin + dt.timedelta(hours=4 * k))} for k in range(400)]
    layer = canon(spark, made).withColumn("probable_error", F.lit(False))
    names = ["temperature_c", "road_incidents"]
    stack = stacked.stacked(layer, names, True)
    models_ = stacked.fit_all(stack, stacked.split(stack, names, 20, 100))
    assert len(models_) == 6 and all(m.converged and 1 < m.rounds < stacked.ROUNDS for m in models_)
    table = stack.rows.toPandas().sort_values(["m", "pos"])
    for m in models_:
        own = table[table["m"] == METRICS.index(m.metric)].iloc[: m.train]
        X, y = stack.recipe.design(np.stack(own["codes"]), own["lag"].to_numpy()), own["y"].to_numpy()
        if m.metric == "temperature_c":
            beta = models.solve(models._moments(X, np.ones(len(y)), y), X.shape[1])
            for _ in range(200):
                r = y - X @ beta
                scale = models.MAD_FACTOR * np.median(np.abs(r - np.median(r)))
                beta = models.solve(models._moments(X, models.huber_weights(r, scale), y), X.shape[1])
            assert m.fit.family == "huber" and np.allclose(X @ m.fit.beta, X @ beta, atol=0.02)
        else:
            beta = np.zeros(X.shape[1])
            beta[0] = np.log(y.mean())
            for _ in range(100):
                mu = np.exp(X @ beta)
                beta = models.solve(models._moments(X, mu, X @ beta + y / mu - 1), X.shape[1])
            assert m.fit.family == "poisson" and np.allclose(X @ m.fit.beta, X @ beta, atol=1e-4)
            assert abs(m.fit.dispersion - ((y - mu) ** 2 / mu).sum() / (len(y) - X.shape[1])) < 1e-3
    cut = stacked.fit_all(stack, stacked.split(stack, names, 20, 100), rounds=1)
    assert not any(m.converged for m in cut) and {m.rounds for m in cut} == {1}


def test_lagged_forecast_scores_against_pandas(spark):
    rng = np.random.default_rng(5)
    made = [{"record_id": f"R{k:04d}", "city": ["Pune", "Delhi"][k % 2], "road_incidents": int(rng.poisson(4)), "timestamp_text": str(dt.datetime(2026, 1, 1) + dt.timedelta(hours=4 * k))} for k in range(240)]
    layer = canon(spark, made).withColumn("probable_error", F.lit(False))
    rows = models.lagged_forecast(layer, ["road_incidents"], replicates=300).orderBy("fold").collect()
    table = layer.toPandas().sort_values(["ts", "record_id"]).reset_index(drop=True)
    table["lag"] = table.groupby("city")["road_incidents"].shift(1)
    table = table[table["lag"].notna()].reset_index(drop=True)
    for r, (_, a, b) in zip(rows, FOLDS):
        train, test = table[: int(len(table) * a)], table[int(len(table) * a) : int(len(table) * b)]
        known, city = train.groupby(["city", "month"])["road_incidents"].median(), train.groupby("city")["road_incidents"].median()
        base = [known.get((c, m), city[c]) for c, m in zip(test["city"], test["month"])]
        assert r["test_n"] == len(test) and np.isclose(r["baseline_mae"], np.abs(test["road_incidents"] - base).mean()) and r["converged"]
        assert r["mae_low"] < r["model_mae"] < r["mae_high"] and r["r2_low"] <= r["r2"] <= r["r2_high"]
