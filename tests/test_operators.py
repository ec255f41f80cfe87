"""Core operators against brute force, and their defined edge cases."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import normal, text
from lodestone.operators import delivery, evidence, graph, positions, rubric, series, snapshots, vectors
from lodestone.sources import jsonl
from tests.conftest import write_evidence


def values(spark, expr_of, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr_of(F.col("c"))).collect()]


def test_identifiers(spark):
    got = values(spark, normal.canonical_id, ["AB12", " sha1:ab12\n", "\tab12 ", "", None, "null", "  "])
    assert got == ["ab12", "ab12", "ab12", None, None, None, None]


def test_permalinks(spark):
    same = ["https://www.Reddit.example/r/a/1/", "http://old.reddit.example/r/a/1", "https://m.reddit.example/r/a/1/?utm_source=x&ref=y#top", "//reddit.example/r//a/1"]
    assert set(values(spark, normal.permalink, same)) == {"reddit.example/r/a/1"}
    assert values(spark, normal.permalink, ["https://n.example/item?id=3&utm_a=1", "https://n.example/item?b=2&a=1", None, ""]) == ["n.example/item?id=3", "n.example/item?a=1&b=2", None, None]


def test_handles_and_times(spark):
    got = values(spark, lambda c: normal.handle(c, "u"), ["u/Ann", "/u/ann", " U/ANN ", "ann", "[deleted]", None, "", "u/"])
    assert got == ["ann"] * 4 + [None] * 4
    got = values(spark, normal.epoch_seconds, [1743465766, 1743465766123, 1743465766123456, 1743465766123456789, 0, -1, None], "bigint")
    assert got == [1743465766] * 4 + [None] * 3


def test_text_functions(spark):
    assert values(spark, text.slug, ["Hello, World!", None, "", "x" * 50 + " y"]) == ["hello-world", None, "", "x" * 40]
    assert values(spark, text.vote_count, ["1,024 points", "3K likes", "7 comments", None, "votes"]) == [1024, None, None, None, None]
    assert values(spark, text.word_count, ["a  b\nc", "", None]) == [3, 0, None]
    assert values(spark, text.fold_quote, ["“a”  ‘b’ – c…"]) == ["\"a\" 'b' - c..."]


def components_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("case", ["random", "chain", "star", "empty"])
def test_components(spark, case):
    rng = random.Random(5)
    edges = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(None, 3), (4, 4)],
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 50)],
        "empty": [],
    }[case]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == components_by_hand(edges)


def test_positions(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(100_000).repartition(3).write.parquet(path)
    scan = positions.scan_with_positions(spark, path, ["id"])
    chosen = positions.write_positions(scan.filter("id % 7 = 0").unionByName(scan.filter("id = 0")), "test")
    kept = scan.filter(positions.position_filter(chosen, inside=True)(positions.FILE, positions.POS))
    assert sorted(r["id"] for r in kept.select("id").collect()) == list(range(0, 100_000, 7))
    nothing = positions.write_positions(scan.filter("id < 0"), "test")
    assert scan.filter(positions.position_filter(nothing, inside=False)(positions.FILE, positions.POS)).count() == 100_000


def test_deliveries(spark, tmp_path):
    rows = [
        dict(row_id=1, id="A", url="https://x.example/1", created_utc=5),
        dict(row_id=2, id=" a ", url="http://www.x.example/1/", created_utc=5),
        dict(row_id=3, id=None, url="https://x.example/1#top", created_utc=5),
        dict(row_id=4, id="b", url="https://x.example/1", created_utc=5),
        dict(row_id=5, id=None, url="https://y.example/2", created_utc=None),
        dict(row_id=6, id="", url="https://y.example/2/", created_utc=None),
        dict(row_id=7), dict(row_id=8),
        dict(row_id=9, id="a", url=None),
    ]
    folder = write_evidence(spark, tmp_path, rows, {"first": 1, "_n": "x", "key_hi": None})
    scan = spark.read.parquet(f"{folder}/evidence_sample.parquet")
    lost = delivery.surplus_deliveries(delivery.message_keys(scan))
    assert {(r["first"], r["row_id"]) for r in lost.collect()} == {(1, 2), (1, 3), (1, 9), (5, 6)}
    kept = delivery.deduplicated(spark, f"{folder}/evidence_sample.parquet")
    assert {r["row_id"] for r in kept.collect()} == {1, 4, 5, 7, 8}
    assert kept.columns == scan.columns


def test_one_hot_message(spark, tmp_path):
    rows = [dict(row_id=i, id="hot" if i % 3 else f"own{i}") for i in range(1, 400)]
    folder = write_evidence(spark, tmp_path, rows)
    kept = delivery.deduplicated(spark, f"{folder}/evidence_sample.parquet", columns=["row_id"])
    assert kept.count() == sum(1 for r in rows if r["id"] != "hot") + 1


def test_null_is_not_zero(spark):
    df = spark.createDataFrame([(None, None), (None, 2), (3, None), (0, 0)], "s bigint, c bigint")
    assert [r[0] for r in df.select(evidence.engagement(F.col("s"), F.col("c"))).collect()] == [None, 2, 3, 0]


PANEL = "query string, member_count bigint, distinct_authors bigint, distinct_communities bigint, engagement_sum bigint"


@pytest.mark.parametrize(
    "m, a, c, e, floor, read",
    [(47, 39, 6, 3021, None, "high"), (40, 12, 4, 10, None, "medium"), (47, 39, 1, 10, None, "medium"), (47, 39, 2, 10, None, "medium"),
     (10, 8, 3, 9000, 5000, "high"), (3, 3, 3, 999999, 5000, "low")],
)
def test_frequency_cases(spark, m, a, c, e, floor, read):
    rows = [("x", m, a, c, e)]
    # Other clusters bring the corpus into the calibrated range and, with a floor, their number to ten.
    rows += [(f"o{i}", (600 - m) // 9, 1, 1, floor or 1) for i in range(9 if floor else 1)]
    if not floor:
        rows[-1] = ("o0", 600 - m, 1, 1, 1)
    df = rubric.frequency_read(spark.createDataFrame(rows, PANEL))
    got = {r["query"]: r for r in df.collect()}["x"]
    assert got["read"] == read
    assert (got["decile_floor"] is None) == (floor is None)


@pytest.mark.parametrize(
    "quotes, score",
    [({"profanity_urgency": "abc"}, 2), ({"workaround_built": "ab"}, 3), ({"workaround_built": "a", "complainer_is_buyer": "b"}, 2),
     ({"money_loss": "ab", "time_quantified": "cd"}, 3), ({"money_loss": "ab", "time_quantified": "cd", "complainer_is_buyer": "a"}, 4),
     ({"money_loss": "a", "time_quantified": "a", "abandonment": "a"}, 2)],
)
def test_intensity_cases(spark, quotes, score):
    rows = [("x", m, a, False) for m, authors in quotes.items() for a in authors]
    df = spark.createDataFrame(rows, "query string, marker string, author string, recurring boolean")
    assert rubric.intensity(df).first()["score"] == score


def test_recurring_buyers_reach_the_top(spark):
    rows = [("x", m, a, a in "ac") for m, authors in {"money_loss": "ab", "time_quantified": "cd", "complainer_is_buyer": "ac"}.items() for a in authors]
    df = spark.createDataFrame(rows, "query string, marker string, author string, recurring boolean")
    assert rubric.intensity(df).first()["score"] == 5


def full_linkage(x, cut_at):
    """Average linkage by the definition."""
    clusters = [[i] for i in range(len(x))]
    d = np.maximum(0, 1 - x @ x.T)
    while len(clusters) > 1:
        best = min((float(np.mean(d[np.ix_(a, b)])), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if best[0] > cut_at + 1e-12:
            break
        clusters[best[1]] = clusters[best[1]] + clusters.pop(best[2])
    return {frozenset(c) for c in clusters}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 9), st.floats(0.1, 1.2))
def test_average_linkage(seed, n, cut_at):
    x = np.random.default_rng(seed).standard_normal((n, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = vectors.average_linkage(n, np.maximum(0, 1 - x @ x.T), cut_at)
    assert {frozenset(i for i in range(n) if labels[i] == k) for k in labels} == full_linkage(x, cut_at)


def test_linkage_over_components(spark):
    x = np.random.default_rng(3).standard_normal((30, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(f"k{i:02}", x[i].tolist()) for i in range(30)], "k string, centroid array<double>")
    got = {}
    for r in vectors.linkage_labels(df, "k", 0.3).collect():
        got.setdefault(r["cluster"], set()).add(int(r["k"][1:]))
    assert {frozenset(v) for v in got.values()} == full_linkage(x, 0.3)


SERIES = "series_id bigint, query string, source string, period string, start_utc bigint, end_utc bigint, hits bigint, is_partial boolean, is_censored boolean"


def shape(spark, counts, fn=series.canonical_shapes):
    rows = [(i, "q", "s", f"20{i:02}", i * 31556952, (i + 1) * 31556952, c, False, None) for i, c in enumerate(counts)]
    return fn(series.cleaned(spark.createDataFrame(rows, SERIES))).first()


def test_canonical_shapes(spark):
    assert shape(spark, [1, 1, 1])["shape"] is None
    assert shape(spark, [1, 1, 50, 1])["shape"] == "spiky-episodic"
    assert shape(spark, [10, 10, 10, 10])["shape"] == "persistent-flat"
    assert shape(spark, [0, 1, 20, 30, 30])["shape"] == "emerging"
    assert shape(spark, [40, 30, 20, 10])["shape"] == "declining"
    nothing = shape(spark, [None, None, None])
    assert nothing["shape"] is None and nothing["coverage"] is None and nothing["total"] is None
    assert shape(spark, [None, 30, 30, 30])["coverage"] == "good"
    assert shape(spark, [None, None, 30, 30])["coverage"] == "thin"


def test_supply_shapes(spark):
    fn = series.supply_shapes
    assert shape(spark, [1, 2], fn)["shape"] == "insufficient-data"
    assert shape(spark, [0, 0, 0], fn)["shape"] == "no-signal"
    assert shape(spark, [0, 0, 3, 4], fn)["shape"] == "emerging"
    assert shape(spark, [2, 20, 5], fn)["shape"] == "spike-and-fade"
    assert shape(spark, [10, 20, 30, 40], fn)["shape"] == "rising"


def test_snapshot_verdicts(spark):
    schema = "k string, members bigint, authors bigint, communities bigint"
    old = spark.createDataFrame([("a", 20, 10, 2), ("b", 20, 10, 2), ("c", 20, 10, 2), ("d", 20, 10, 2), ("gone", 3, 1, 1)], schema)
    new = spark.createDataFrame([("a", 30, 18, 3), ("b", 30, 11, 2), ("c", 10, 5, 1), ("d", 21, 10, 2), ("new", 3, 1, 1)], schema)
    got = {r["k"]: r["verdict"] for r in snapshots.verdicts(old, new, "k").collect()}
    assert got == {"a": "grew-broadly", "b": "grew-narrowly", "c": "shrank", "d": "flat", "gone": "vanished", "new": "new"}
    held = {r["k"]: r["verdict"] for r in snapshots.verdicts(old, new, "k", F.lit(True)).collect()}
    assert held["c"] == "unresolved" and held["gone"] == "unresolved" and held["a"] == "grew-broadly"


def test_json_lines(spark, tmp_path):
    good, bad = tmp_path / "a", tmp_path / "b"
    good.mkdir(), bad.mkdir()
    (good / "x.jsonl").write_text('{"id": "1", "engagement": {"score": 3}}\n{"id": "2", "title": null}\n')
    (bad / "y.jsonl").write_text('{"id": "3"}\n{"id": tru\n[1, 2]\n')
    rows, health = jsonl.scan(spark, [str(good), str(bad), str(good) + "/"])
    assert sorted(r["id"] for r in rows.collect()) == ["1", "2", "3"]
    by = {r["_file"].rsplit("/", 1)[1]: (r["dropped"], r["status"]) for r in health.collect()}
    assert by == {"x.jsonl": (0, "ok"), "y.jsonl": (2, "degraded")}
    for name, body in (("l", '{"source": "a", "status": "ok"}\n{"source": "b", "status": "degraded"}\n'), ("j", json.dumps([{"source": "c", "status": "ok"}]))):
        (tmp_path / name).write_text(body)
    assert [r["source"] for r in jsonl.read_health(spark, str(tmp_path / "l")).collect()] == ["a", "b"]
    assert [r["source"] for r in jsonl.read_health(spark, str(tmp_path / "j")).collect()] == ["c"]


def test_append_new(spark, tmp_path):
    out = str(tmp_path / "out")
    first = spark.createDataFrame([("1", "a"), ("1", "a"), (None, "n")], "id string, v string")
    jsonl.append_new(first, out)
    jsonl.append_new(spark.createDataFrame([("1", "b"), ("2", "c")], "id string, v string"), out)
    assert sorted((r["id"] or "-", r["v"]) for r in spark.read.json(out).collect()) == [("-", "n"), ("1", "a"), ("2", "c")]


def test_round_robin(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 6 else "a") for i in range(12)], "i bigint, g string")
    got = {r["i"]: r["turn"] for r in evidence.round_robin(df, "g", "i", slices=4).collect()}
    for g in "ab":
        mine = [i for i in range(12) if ("ab"[i % 2] if i < 6 else "a") == g]
        assert [got[i] for i in mine] == list(range(1, len(mine) + 1))


def test_sql_functions(spark):
    from lodestone.functions import sql

    assert "cosine_distance" in sql.register(spark)
    r = spark.sql("select cosine_distance(array(1D, 0D), array(0D, 1D)) d, engagement_of(null, 3) e, engagement_of(null, null) n, half_year(1719792000) h, fold_quote('a “b”  c…') f, word_count(' a  b ') w").first()
    assert (r["d"], r["e"], r["n"], r["h"], r["f"], r["w"]) == (1.0, 3, None, "2024-H2", 'a "b" c...', 2)


def test_inputs_and_documents(spark, tmp_path):
    from lodestone.sources import jsonl

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"source": "s", "status": "ok"}\n')
    (tmp_path / "a" / ".y.jsonl").write_text("{}\n")
    files, problems = jsonl.inputs(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/a/x.jsonl", f"file://{tmp_path}/none"])
    assert len(files) == 1 and [r["problem"] for r in problems.collect()] == ["not found"]
    (tmp_path / "d.json").write_text('{\n "source": "s"\n}')
    assert jsonl.document(spark, f"file://{tmp_path}/d.json", jsonl.HEALTH).first()["source"] == "s"
    assert jsonl.document(spark, f"file://{tmp_path}/no.json", jsonl.HEALTH).count() == 0
    odd = spark.createDataFrame([(1.5, "a"), (float("nan"), None), (float("inf"), "b")], "x double, y string")
    assert [r["json"] for r in jsonl.strict_json(odd).collect()] == ['{"x":1.5,"y":"a"}', '{"x":null,"y":null}', '{"x":null,"y":"b"}']


def test_density_clusters_by_hand():
    from lodestone.operators import pools

    rng = np.random.default_rng(5)
    centers = rng.standard_normal((4, 16))
    x = np.concatenate([c + 0.05 * rng.standard_normal((12, 16)) for c in centers] + [rng.standard_normal((6, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = pools.density_labels(x, 4)
    for k in range(4):
        assert len(set(label[12 * k : 12 * k + 12])) == 1 and label[12 * k] != -1
    assert len({label[12 * k] for k in range(4)}) == 4
    tree = pools.spanning_tree(x)
    d = np.maximum(0, 1 - x @ x.T)
    # Prim's tree weighs as much as the one that joins components by the shortest edge.
    parts, weight = list(range(len(x))), 0.0
    for i, j in sorted(((i, j) for i in range(len(x)) for j in range(i)), key=lambda p: d[p]):
        if parts[i] != parts[j]:
            weight += d[i, j]
            parts = [parts[j] if p == parts[i] else p for p in parts]
    assert abs(tree[:, 0].sum() - weight) < 1e-9
    assert set(pools.density_labels(x[:1])) == {-1} and len(pools.density_labels(np.zeros((0, 3)))) == 0
    # A cut wider than the births of all clusters merges them upwards, and never to the root.
    assert len(set(pools.density_labels(x, 4, 1e-9)) - {-1}) == len(set(label) - {-1})


def test_tiles_hold_every_pair_once(spark, monkeypatch):
    from lodestone.operators import pools

    monkeypatch.setattr(pools, "TILE", 7)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(0, i, x[i].tolist()) for i in range(40)] + [(1, 99, [1.0, 0.0, 0.0, 0.0, 0.0]), (1, 100, None)], "pool int, k bigint, v array<double>")
    want = np.maximum(0, 1 - x @ x.T)[np.triu_indices(40, 1)]
    counts = pools.distance_counts(df, "pool", "k", "v")
    assert counts.agg(F.sum("n")).first()[0] == len(want)
    c = pools.cuts(df, "pool", "k", "v").collect()
    assert len(c) == 1 and abs(c[0]["cut"] - np.percentile(np.repeat(want, 2), 35)) < 2e-6 and abs(c[0]["p75"] - np.percentile(want, 75)) < 1e-4
    pairs = {(r["a"], r["b"]) for r in pools.close_pairs(df, "pool", "k", "v", 0.4).collect()}
    assert pairs == {(i, j) for i in range(40) for j in range(i + 1, 40) if 1 - x[i] @ x[j] <= 0.4}


def test_merging_twice_changes_nothing(spark):
    from lodestone.operators import spine

    schema = "source string, id string, row_id bigint"
    staged = spark.createDataFrame([("reddit", "a", 3), ("reddit", "a", 4), ("odd", "b", 5), ("reddit", None, 6)], schema)
    kept, report = spine.merged(spark.createDataFrame([("reddit", "a", 9)], schema), staged, ["reddit"])
    assert [(r["id"], r["row_id"], r["added"]) for r in kept.collect()] == [("a", 9, False)]
    assert {r["source"]: (r["written"], r["without_id"], r["status"]) for r in report.collect()} == {"reddit": (1, 1, "merged"), "odd": (0, 0, "not merged: unknown source")}
    again, _ = spine.merged(kept.select("source", "id", "row_id"), staged, ["reddit"])
    assert again.count() == 1


def test_intermediate_tables_are_released(spark):
    from lodestone import runtime

    df = runtime.cut(spark.range(3), "kept")
    assert df.count() == 3 and runtime.release(spark) >= 1
    assert runtime.names_in(spark, df._lodestone_path) == []
