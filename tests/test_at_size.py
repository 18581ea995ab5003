"""Queries on tables that the small test data does not have: gaps, ties, series without spread, many copies."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from siglake import plans
from siglake.plans import registry

plans.load()


def embeddings(ids, values):
    return "embeddings", pd.DataFrame({"vec_id": np.asarray(ids, dtype="int64"), "embedding": [np.asarray(v, dtype="float32") for v in values], "label": 0})


def both(spark, folder, name, *tables):
    """The query's rows and those of its SQL, in order."""
    duck = duckdb.connect()
    for t, df in tables:
        duck.register("own", df)
        kind = {"embeddings": "REPLACE (embedding::FLOAT[] AS embedding)", "events": "REPLACE (ts::TIMESTAMP AS ts)"}.get(t, "")
        duck.execute(f"COPY (SELECT * {kind} FROM own) TO '{folder}/{t}.parquet'")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, str(folder)).toPandas()
    want = duck.execute(registry.ORACLES[name]).df() if name in registry.ORACLES else None
    return tuple(None if df is None else df[sorted(df.columns)].sort_values(sorted(df.columns), ignore_index=True) for df in (got, want))


def same(spark, folder, name, *tables):
    got, want = both(spark, folder, name, *tables)
    assert len(want)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_median_highpass_of_gaps_and_ties(spark, tmp_path):
    """Samples 2 and 13 are missing, the last ten have six, and a 128th lies between two rounded values."""
    ids = [k for k in range(26) if k not in (2, 13)]
    same(spark, tmp_path, "median_highpass", embeddings(ids, np.random.default_rng(1).integers(-200, 200, (len(ids), 64)) / 128))


def series(x, y):
    """Events of users 1 and 2, a sample a minute."""
    rows = [(k * 2 + u, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k), u + 1, "click", float(v)) for u, of in enumerate((x, y)) for k, v in enumerate(of)]
    return "events", pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])


def test_running_corrcoef_of_constant_windows(spark, tmp_path):
    """As where each event is held sixty times; the last window has spread in both."""
    x, y = np.random.default_rng(2).standard_normal((2, 64))
    x[:16], y[16:32], x[32:48], y[32:48] = 0.1, 0.3, 0.7, 0.1
    same(spark, tmp_path, "running_corrcoef", series(x, y))


def test_running_corrcoef_of_all_pairs(spark, tmp_path):
    """Users far apart too, of one to three complete windows; the last two share no sample of the first window, and one is constant where another has samples."""
    r, lengths = np.random.default_rng(11), {1: 48, 2: 40, 7: 31, 30: 15, 41: 48, 500: 33}
    rows = [(k * 1000 + u, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k), u, "click", r.standard_normal()) for u, n in lengths.items() for k in range(n)]
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    k = (df["event_id"] - df["user_id"]) // 1000
    df.loc[(df["user_id"] == 41) & (k < 16) & (k % 2 == 0) | (df["user_id"] == 500) & (k < 16) & (k % 2 == 1) | (df["user_id"] == 2) & k.between(16, 20), "value"] = None
    df.loc[(df["user_id"] == 7) & (k < 16) & (k % 2 == 0), "value"] = 0.1
    same(spark, tmp_path, "running_corrcoef", ("events", df))
    got = registry.QUERIES["running_corrcoef"](spark, str(tmp_path)).toPandas()
    assert {w: set(zip(p["user_id"], p["other"], strict=True)) for w, p in got.groupby("win")} == {
        w: {(a, b) for a in lengths for b in lengths if a < b and min(lengths[a], lengths[b]) >= 16 * (w + 1)} for w in range(3)
    }


def test_blocks_of_pair_correlations(spark):
    """Blocks of two series give what one block of all gives, each pair once."""
    from siglake.operators import windows

    r = np.random.default_rng(12)
    samples = spark.createDataFrame([(u, i, float(r.integers(0, 4))) for u in range(0, 90, 10) for i in range(12)], "user_id long, i long, x double")
    one, many = (windows.pair_correlations(samples, "user_id", 4, block=n).toPandas().sort_values(["win", "user_id", "other"], ignore_index=True) for n in (windows.BLOCK, 2))
    assert len(one) == 3 * 9 * 8 // 2 and (one["user_id"] < one["other"]).all() and not one.duplicated(["win", "user_id", "other"]).any()
    pd.testing.assert_frame_equal(one, many)


def test_capon_beamformer_of_few_frames(spark, tmp_path):
    """Groups of 32, 1 and 3 frames, and of 32 without any signal."""
    ids = [*range(32), 64, 97, 98, 99, *range(128, 160)]
    values = np.random.default_rng(3).standard_normal((len(ids), 64))
    values[-32:] = 0
    got, _ = both(spark, tmp_path, "capon_beamformer", embeddings(ids, values))
    power = got.groupby("g")["p"]
    assert power.size().to_dict() == {0: 49, 2: 49, 3: 49, 4: 49}
    assert np.isfinite(got["p"]).all() and (power.min().loc[[0, 2, 3]] > 0).all() and power.max()[4] == 0


@pytest.mark.parametrize("name", ["neighborfunc_mean", "neighborfunc_std", "neighborfunc_median", "extrapolate_bads_median", "extrapolate_bads_mean", "gaussian_spatial"])
def test_neighbours_are_not_joined(spark, tmp_path, name):
    """A frame goes through one exchange, without a join or a row for each neighbour; values have ties and gaps."""
    values = np.random.default_rng(4).integers(-4, 5, (40, 64)) / 8
    same(spark, tmp_path, name, embeddings(range(7, 47), values))
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange") == 1


#: Those of the last round that the driver stopped by memory.
BY_FRAME = ["neighborfunc_std", "extrapolate_bads_mean", "neighborfunc_median"]


@pytest.mark.parametrize("name", BY_FRAME)
def test_frames_stay_frames(spark, tmp_path, name):
    """The rows of a frame are made behind the exchange only: none is sorted, gathered or held by an aggregate."""
    _, df = embeddings(range(7, 47), np.random.default_rng(8).integers(-4, 5, (40, 64)) / 8)
    same(spark, tmp_path, name, ("embeddings", df))
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not [x for x in ("Aggregate", "Generate", "Sort", "ArrowEvalPython") if x in plan] and "MapInArrow" in plan


def test_around_of_ragged_frames(spark):
    """Frames of several layouts and keys, in any order, with a missing value and further columns; each as if it stood alone."""
    from siglake.operators import spatial

    r = np.random.default_rng(9)
    full = [(a, m) for a in range(3) for m in range(4)]
    rows = [(k, f"s{k % 2}", int(a), int(m), None if (k, a, m) == (2, 1, 1) else float(r.integers(0, 9)), k * 100 + a * 10 + m) for k in range(6) for a, m in (full if k % 3 else full[:7]) if (k, a, m) != (1, 0, 0)]
    rows.append((9, "s1", 5, 5, 1.0, 9))
    grid = spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], "g long, s string, ap int, ml int, x double, tag long")
    got = spatial.around(grid, ["g", "s"], spatial.footprint(1), spatial.mean_of, "y")
    assert got.columns == [*grid.columns, "y"]
    at, found = {(g, a, m): x for g, _, a, m, x, _ in rows}, {tuple(x[:6]): x[6] for x in got.collect()}
    assert len(found) == len(rows)
    for g, s, a, m, x, tag in rows:
        near = [v for da, dm in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (v := at.get((g, a + da, m + dm))) is not None]
        assert found[g, s, a, m, x, tag] == (pytest.approx(sum(near) / len(near)) if near else None)


def errors(n, copies, seed):
    """Errors of all quadrants within two hours, each held `copies` times under further ids; some stand exactly 700 s apart."""
    r = np.random.default_rng(seed)
    at, user, value = np.concatenate([r.integers(0, 7200, n - 20), np.arange(20) * 700]), r.integers(0, 256, n), r.standard_normal(n).round(2)
    rows = [(k + 1007 * c, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=int(at[k])), int(user[k]), "error", value[k]) for k in range(n) for c in range(copies)]
    return "events", pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])


@pytest.mark.parametrize(("n", "copies"), [(60, 1), (30, 8)])
@pytest.mark.parametrize("name", ["find_merge_clusters", "merge_bursts"])
def test_bursts_of_copies(spark, tmp_path, name, n, copies):
    same(spark, tmp_path, name, errors(n, copies, n), embeddings(range(50), np.random.default_rng(5).standard_normal((50, 64))))


def test_runs_stand_for_pairs(spark, tmp_path, monkeypatch):
    """200 copies of 20 bursts at one time would be 8 million pairs; what is linked are runs, one of a signal and quadrant at most."""
    from siglake.operators import bursts

    seen, components = [], bursts.components
    monkeypatch.setattr(bursts, "components", lambda pairs, a, b: seen.append(pairs.count()) or components(pairs, a, b))
    both(spark, tmp_path, "assign_quadrants", errors(20, 200, 3), embeddings(range(50), np.random.default_rng(6).standard_normal((50, 64))))
    assert registry.QUERIES["find_merge_clusters"](spark, str(tmp_path)).count() and seen[0] < 200 * 200


def test_digests():
    import hashlib

    from siglake.functions.digests import md5_order

    heads, tails = [b"", b"7:12", b"39:123456", b"k" * 60], [b":0:0", b":10:3", b":" * 46, b""]
    got = md5_order(heads, tails)
    assert got.tolist() == [[int(hashlib.md5(h + t).hexdigest()[:16], 16) for t in tails] for h in heads]


def test_surrogate_test_shuffles_within_a_frame(spark, tmp_path):
    """Smooth, random and constant frames; nothing is joined, and frames alone are exchanged."""
    r, smooth = np.random.default_rng(7), np.add.outer(np.arange(8), np.arange(8)).ravel() / 10
    same(spark, tmp_path, "surrogate_test", embeddings([3, 99, 1234567, 5], [smooth, *r.standard_normal((2, 64)), np.full(64, 0.3)]))
    plan = registry.QUERIES["surrogate_test"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_linked_runs_are_a_forest(spark, tmp_path, monkeypatch):
    """60 bursts at one place under fifty signals each: hundreds of pairs of runs meet at a time, but a task keeps fewer links than runs."""
    from siglake.operators import bursts, graph

    seen, components = [], bursts.components
    monkeypatch.setattr(bursts, "components", lambda pairs, a, b: seen.append((pairs.rdd.glom().map(len).collect(), pairs.select(a).union(pairs.select(b)).distinct().count())) or components(pairs, a, b))
    rows = [(k * 50 + s, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=1000 * k), 17, "error", float(s)) for k in range(60) for s in range(50)]
    tables = ("events", pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])), embeddings(range(50), np.random.default_rng(10).standard_normal((50, 64)))
    same(spark, tmp_path, "find_merge_clusters", *tables)
    (sizes, runs), = seen
    assert runs > 2900 and all(n < runs for n in sizes) and sum(sizes) < 60 * 50 * 3
    monkeypatch.setattr(graph, "MOST_NODES", 10)
    monkeypatch.setattr(bursts, "MOST_ALIKE", 0)
    same(spark, tmp_path, "merge_bursts", *tables)


def test_forest_reaches_the_same_nodes(spark):
    from siglake.operators.graph import components, forest

    r = np.random.default_rng(11)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(7, 7)], "a long, b long").repartition(3)
    small = forest(pairs, "a", "b")
    want = {(x.node, x.cluster) for x in components(pairs.where("a <> b"), "a", "b").collect()}
    assert {(x.node, x.cluster) for x in components(small, "a", "b").collect()} == want and small.count() < 300


#: Runs a function of Arrow batches as a new Python worker does.
WORKER = """
import pickle, sys
import pyarrow as pa
folder = sys.argv[1]
run = pickle.load(open(f"{folder}/run", "rb"))
rows = [b.num_rows for b in run(iter(pa.ipc.open_stream(open(f"{folder}/batches", "rb").read())))]
print(sum(rows), max(rows), "pandas" in sys.modules)
"""


def test_workers_of_neighbours_stay_small(spark, tmp_path, monkeypatch):
    """Stored arrays go to a worker as they are; it doesn't import pandas, and hands rows back some ten thousand at once."""
    import subprocess
    import sys
    from pathlib import Path

    import pyarrow as pa
    from pyspark import cloudpickle

    kind, sent = type(spark.range(0)), []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, f=kind.mapInArrow, **b: sent.append((self, run)) or f(self, run, *a, **b))
    same(spark, tmp_path, "neighborfunc_median", embeddings(range(3000), np.random.default_rng(10).standard_normal((3000, 64)).round(2)))
    (frames, run), *more = sent
    assert not more and [f.dataType.simpleString() for f in frames.schema] == ["bigint", "array<float>"]
    table = frames.toArrow()
    with pa.ipc.new_stream(f"{tmp_path}/batches", table.schema) as out:
        out.write_table(table.combine_chunks())
    (tmp_path / "run").write_bytes(cloudpickle.dumps(run))
    said = subprocess.run([sys.executable, "-c", WORKER, str(tmp_path)], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=60)
    assert said.returncode == 0, said.stderr
    rows, most, pandas = said.stdout.split()
    assert int(rows) == 3000 * 64 and int(most) <= 20_000 and pandas == "False"


def test_around_of_stored_frames(spark):
    """As `around_gathered` of the same frames: of several lengths, empty, without an array, with nulls and NaN, under two keys."""
    from siglake.functions import neighbors
    from siglake.operators import spatial

    r = np.random.default_rng(11)
    full = [[float(v) for v in r.integers(0, 9, n)] for n in (12, 12, 7, 1, 12)]
    full[1][5], full[4][0], full[4][7], full[2][:] = None, float("nan"), None, [None] * 7
    own = [(k, f"s{k % 2}" if k else None, v) for k, v in enumerate([*full, [], None])]
    stored = spark.createDataFrame(own, "g long, s string, v array<float>").coalesce(1)
    near = spatial.footprint(2)
    rows = spark.createDataFrame([(g, s, [(k // 4, k % 4, x) for k, x in enumerate(v or [])]) for g, s, v in own], "g long, s string, r array<struct<ap: int, ml: int, x: double>>")
    for kernel in (neighbors.mean_of, neighbors.std_of, neighbors.median_of):
        got = spatial.around_stored(stored, ["g", "s"], "v", 4, near, kernel, "y")
        want = spatial.around_gathered(rows, ["g", "s"], near, kernel, "y").drop("x")
        assert got.columns == want.columns
        got, want = (sorted(repr((*x[:-1], x[-1] if x[-1] is None else round(x[-1], 9))) for x in of.collect()) for of in (got, want))
        assert len(got) == 44 and got == want
