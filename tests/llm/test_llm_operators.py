"""Training-data operators against brute force, and their defined edge cases."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import llm
from lodestone.functions import normal
from lodestone.llm import encoding, fusion, garbled, ledger, mixing, near_copies, personal, quotas, themes
from tests.compare import same
from tests.conftest import EVIDENCE, evidence_row, write_evidence

QUERIES, ORACLES = llm.queries(), llm.oracle_sql()
CLASH = {"n": 1, "key": "k", "post": None, "kept": True, "kind": "x", "first": 2, "group": 3, "cluster": 4}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    same(QUERIES[name](spark, small), ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == 0 or name in ("p9_shares", "p9_filled")


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n[:2] in ("p1", "p2", "p3", "p4", "p5", "p6") and n[2] == "_"])
def test_null_rows_and_clashing_columns(spark, tmp_path, small, name):
    """Rows that are null in every column but row_id, rows of blanks, and extra columns with names used inside."""
    blanks = dict(id=" ", cell_id="", source="", url=" ", title="", text=" ", author="", community=" ", engagement=(None, None), created_utc=0, captured_utc=0)
    rows = [dict(row_id=i) for i in range(1, 6)] + [dict(row_id=i, **blanks) for i in range(6, 9)]
    rows = [{**r, "source": r.get("source")} for r in rows]
    folder = write_evidence(spark, tmp_path, rows, CLASH)
    for other in ("matrix", "cluster_audit"):
        spark.read.parquet(f"{small}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
    QUERIES[name](spark, folder).collect()


# 1 -------------------------------------------------------------------------------------------------


def frame(spark, rows):
    return spark.createDataFrame([evidence_row(**r) for r in rows], EVIDENCE)


def test_posts_by_hand(spark, small):
    from pyspark.sql import SparkSession  # noqa: F401

    raw = spark.read.parquet(f"{small}/evidence_sample.parquet")
    flat = raw.select("row_id", normal.canonical_id(F.col("id")).alias("i"), normal.permalink(F.col("url")).alias("u"), "created_utc").collect()
    parent = {r["row_id"]: r["row_id"] for r in flat}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for r in flat:
        if r["i"]:
            by["i", r["i"]].append(r["row_id"])
        if r["u"]:
            by["u", r["u"], r["created_utc"]].append(r["row_id"])
    for rows in by.values():
        for x in rows[1:]:
            a, b = sorted((find(rows[0]), find(x)))
            parent[b] = a
    groups = defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    want = {k: v for k, v in groups.items() if len(v) > 1}
    got = defaultdict(set)
    for r in fusion.posts(raw).collect():
        got[r["post"]].add(r["row_id"])
    assert dict(got) == want


def test_best_row_and_fused_fields(spark):
    cells = spark.createDataFrame([("m01",), ("m02",)], "cell_id string")
    rows = [
        dict(row_id=1, id="a", url="https://x.example/1", created_utc=1, cell_id="m01", engagement=(5, 0), captured_utc=100, source="s1"),
        dict(row_id=2, id="A", url="https://x.example/1", created_utc=1, cell_id=" M01", engagement=(2147483647, 0), captured_utc=900, source="s1"),
        dict(row_id=3, id="b", url="https://x.example/1/", created_utc=1, cell_id="m02", engagement=(7, 0), captured_utc=200_000_000_000, source="s2"),
        dict(row_id=4, id="b", url=None, created_utc=1, cell_id="m01", engagement=(7, 0), captured_utc=150, source="s3"),
        dict(row_id=5, id="single", url="https://x.example/2", created_utc=1),
        dict(row_id=6, id="c"), dict(row_id=7, id="c"),
    ]
    got = {r["first_row_id"]: r for r in fusion.fused_posts(frame(spark, rows), cells).collect()}
    assert set(got) == {1, 6}
    assert (got[1]["best_row_id"], got[1]["n_rows"], got[1]["cell_id"], got[1]["score"]) == (3, 4, "m01", 7)
    assert (got[6]["best_row_id"], got[6]["cell_id"], got[6]["score"], got[6]["captured_utc"]) == (6, None, None, None)


def test_truth_discovery_learns_who_is_reliable(spark):
    rng = random.Random(1)
    rows = []
    for post in range(60):
        for s in ("good1", "good2", "bad1", "bad2", "bad3"):
            wrong = s.startswith("bad") and rng.random() < 0.7
            rows.append((post, s, "f", f"wrong{rng.randrange(3)}" if wrong else "right", 1))
    values, trust, ended = fusion.discover(spark.createDataFrame(rows, "post bigint, source string, field string, value string, latest bigint"))
    r = {x["source"]: x["reliability"] for x in trust.collect()}
    assert min(r["good1"], r["good2"]) > max(r[s] for s in r if s.startswith("bad"))
    assert all(v["value"] == "right" for v in values.collect())
    assert ended["settled"] and 1 < ended["rounds"] < 40


def test_truth_discovery_ends_where_votes_swing(spark):
    schema = "post bigint, source string, field string, value string, latest bigint"
    rows = [(p, s, "f", v, None) for p in range(6) for s, v in (("a", "x"), ("b", "y"))] + [(9, "a", "f", None, 1)]
    values, _, ended = fusion.discover(spark.createDataFrame(rows, schema))
    assert ended["settled"] and {r["value"] for r in values.collect()} == {"x"}
    none, _, ended = fusion.discover(spark.createDataFrame([], schema))
    assert none.count() == 0 and ended["settled"]


# 2 -------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8), st.integers(1, 60))
def test_largest_remainder(sizes, cap):
    seats = quotas.largest_remainder([n**0.5 for n in sizes], sizes, cap)
    assert sum(seats) == min(cap, sum(sizes))
    assert all(0 <= s <= n for s, n in zip(seats, sizes))


def test_proportional_seats():
    assert quotas.largest_remainder([6, 3, 1], [600, 300, 100], 10) == [6, 3, 1]
    assert quotas.largest_remainder([1, 1, 1], [1, 50, 50], 9) == [1, 4, 4]


def test_caps_by_hand(spark):
    rng = random.Random(2)
    rows = [("author", rng.choice("aaab"), rng.choice(["x", "y", None]), rng.choice([None, 1, 1, 2, 5]), i) for i in range(400)] + [("author", None, "x", 1, 999)]
    df = spark.createDataFrame(rows, "kind string, contributor string, stratum string, quality bigint, row_id bigint")
    caps = spark.createDataFrame([("author", 37)], "kind string, cap bigint")
    got = {r["row_id"]: r["kept"] for r in quotas.split_by_cap(df, caps).collect()}
    for who in "ab":
        mine = [r for r in rows if r[1] == who]
        cells = defaultdict(list)
        for r in mine:
            cells[r[2] or ""].append(r)
        names = sorted(cells)
        seats = quotas.largest_remainder([len(cells[c]) ** 0.5 for c in names], [len(cells[c]) for c in names], 37) if len(mine) > 37 else [len(cells[c]) for c in names]
        for c, n in zip(names, seats):
            ranked = sorted(cells[c], key=lambda r: (r[3] is None, -(r[3] or 0), r[4]))
            for i, r in enumerate(ranked):
                assert got.get(r[4], True) == (i < n)


# 3 -------------------------------------------------------------------------------------------------


def near_by_hand(rows, least=0.45):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}


def edited(rng, words, share):
    out = [w for w in words if rng.random() > share / 2]
    return [rng.choice(words) if rng.random() < share / 2 else w for w in out]


@pytest.mark.parametrize("page", [near_copies.PAGE, 8])
def test_near_copies_by_hand(spark, tmp_path, page):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    rows, i = [], 0
    for base in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 15, 30, 120, 300]))]
        for copy in range(rng.choice([1, 2, 5])):
            i += 1
            rows.append((i, " ".join(words if copy == 0 else edited(rng, words, rng.choice([0.02, 0.1])))))
    # One hot group: many near copies of one text, more than a page holds.
    hot = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(40):
        i += 1
        rows.append((i, " ".join(edited(rng, hot, 0.03))))
    unique = {}
    for r, t in rows:
        unique.setdefault("".join(t.split()), (r, t))
    folder = write_evidence(spark, tmp_path, [dict(row_id=r, text=t) for r, t in rows] + [dict(row_id=1000 + k, text=t) for k, t in enumerate([None, "", "[removed]", "two words"])])
    groups, links = near_copies.near_copies(spark, f"{folder}/evidence_sample.parquet", page=page)
    got = {(r["a"], r["b"]) for r in links.collect()}
    want = near_by_hand(unique.values())
    assert got == want
    labels = {r["row_id"]: r["group"] for r in groups.collect()}
    assert all(labels[a] == labels[b] for a, b in want)


def test_near_copies_in_rounds_leave_no_shuffles(spark, tmp_path, monkeypatch):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    monkeypatch.setattr(near_copies, "ROUND_ROWS", 20, raising=False)
    rng = random.Random(31)
    rows = []
    for base in range(30):
        # More letters than ASCII, words of one text in capitals, and some longer than any table of places.
        words = [rng.choice(["naïve", "ΣΑΣ", "İz", "x²", "a_b", "日本"]) + str(rng.randrange(60)) for _ in range(40)] + ["long" * (base % 7 * 20)]
        rows += [(10 * base + k, " ".join(edited(rng, words, 0.1 * k))) for k in range(5)]
    folder = write_evidence(spark, tmp_path, [dict(row_id=r, text=t) for r, t in rows])
    before = shuffled()
    links = near_copies.near_copies(spark, f"{folder}/evidence_sample.parquet")[1]
    left = shuffled() - before
    assert not left
    unique = {}
    for r, t in rows:
        unique.setdefault(t, (r, t))
    want = near_by_hand(unique.values())
    assert len(want) > 50
    assert {(r["a"], r["b"]) for r in links.collect()} == want


def test_runs_are_counted_over_all_contents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_copies, "ORDERED", 10, raising=False)
    seen = []
    monkeypatch.setattr(near_copies, "stored_points", lambda *args, f=near_copies.stored_points: (seen.append(args[3]), f(*args))[1])
    rng = random.Random(9)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(40)]) for _ in range(50)) for _ in range(200)]
    # Copies of a content count once.
    folder = write_evidence(spark, tmp_path, [dict(row_id=i, text=t) for i, t in enumerate(texts + texts[:30] + [None, "", "two words"])])
    near_copies.near_copies(spark, f"{folder}/evidence_sample.parquet")
    run = np.concatenate([near_copies.runs_of(*near_copies.word_hashes([None], [t]))[1] for t in texts])
    at, least = np.unique((run % np.uint64(near_copies.BUCKETS)).astype(np.int64), return_counts=True)
    assert (seen[0][at] >= least).all()
    assert seen[0].sum() == 200 * 48


def test_long_texts_without_a_long_common_run(spark, tmp_path):
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(20_000)]
    rows = []
    for base in range(12):
        words = rng.sample(vocabulary, 100 + 20 * base)
        every = 8 + base % 4
        rows += [(2 * base + 1, " ".join(words)), (2 * base + 2, " ".join(f"x{base}y{k}" if k % every == every - 1 else w for k, w in enumerate(words)))]
    folder = write_evidence(spark, tmp_path, [dict(row_id=r, text=t) for r, t in rows])
    links = near_copies.near_copies(spark, f"{folder}/evidence_sample.parquet")[1]
    want = near_by_hand(rows)
    assert len(want) >= 9
    assert {(r["a"], r["b"]) for r in links.collect()} == want


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], 80)) for _ in range(30)]
    words, counts = near_copies.word_hashes([None] * 30, texts)
    row, run, _, _ = near_copies.runs_of(words, counts)
    n, bits, spare = near_copies.points(row, run, 30)
    sets = [set(run[row == i].tolist()) for i in range(30)]
    assert [len(s) for s in sets] == n.tolist()
    for a, b in combinations(range(30), 2):
        bound = int(np.bitwise_count(bits[a] & bits[b]).sum()) + min(spare[a], spare[b])
        assert bound >= len(sets[a] & sets[b])
    order = np.argsort(n, kind="stable")
    forest = near_copies.CountForest(np.zeros(30), n[order], spare[order], near_copies.reach(n[order], np.zeros(30), 0.2), order, bits.view(np.uint64), 0.2)
    i, j = forest.join()
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    assert {(a, b) for a, b in combinations(range(30), 2) if len(sets[a] & sets[b]) >= 0.2 * len(sets[a] | sets[b])} <= found


def test_a_tree_of_several_levels_loses_no_pair():
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(110):
        words = rng.choice([f"w{i}" for i in range(300)], rng.integers(20, 90))
        texts += [" ".join(np.where(rng.random(len(words)) < 0.06, "x", words)) for _ in range(40)]
    words, counts = near_copies.word_hashes([None] * len(texts), texts)
    row, run, start, _ = near_copies.runs_of(words, counts)
    n, bits, spare = near_copies.points(row, run, len(texts))
    place = rng.integers(0, 8, len(texts))
    page = rng.choice(5, len(texts), p=[0.6, 0.2, 0.1, 0.09, 0.01])
    order = np.lexsort((n, page))
    forest = near_copies.CountForest(page[order], n[order], spare[order], near_copies.reach(n, place, 0.45)[order], order, bits.view(np.uint64), 0.45)
    assert len(forest.levels) == 3
    i, j = forest.join(step=500)
    found = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    assert len(found) == len(i)
    sets = [set(run[s : s + m].tolist()) for s, m in zip(start, n)]
    for a, b in combinations(range(0, len(texts), 7), 2):
        common = len(sets[a] & sets[b])
        if page[a] == page[b] and common >= 0.45 * (n[a] + n[b] - common) and common <= min(n[a] - place[a], n[b] - place[b]):
            assert (a, b) in found


def test_unlike_points_end_at_half_the_groups(monkeypatch):
    compared = []
    monkeypatch.setattr(near_copies.CountForest, "_common", lambda self, x, i, j, f=near_copies.CountForest._common: (compared.append(len(i)), f(self, x, i, j))[1])
    rng = np.random.default_rng(7)
    words, counts = near_copies.word_hashes([None] * 200, [" ".join(rng.permutation([f"w{i}" for i in range(5_000)])[:110]) for _ in range(200)])
    row, run, _, _ = near_copies.runs_of(words, counts)
    n, bits, spare = near_copies.points(row, run, 200)
    forest = near_copies.CountForest(np.zeros(200), n, spare, near_copies.reach(n, np.zeros(200), 0.45), np.arange(200), bits.view(np.uint64), 0.45)
    assert not forest.join().size
    assert sum(compared) < 1.1 * 200 * 199 / 2


def test_levels_of_several_counts_lose_no_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_copies, "LEVELS", 3, raising=False)
    rng = random.Random(12)
    rows = []
    for base in range(40):
        words = [f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(60)]
        rows += [(10 * base + k, " ".join(edited(rng, words, 0.07 * k))) for k in range(5)]
    folder = write_evidence(spark, tmp_path, [dict(row_id=r, text=t) for r, t in rows])
    links = near_copies.near_copies(spark, f"{folder}/evidence_sample.parquet", page=8)[1]
    unique = {}
    for r, t in rows:
        unique.setdefault(t, (r, t))
    want = near_by_hand(unique.values())
    assert len(want) > 50
    assert {(r["a"], r["b"]) for r in links.collect()} == want


def test_contents_are_split_once(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Role: b; Notes: a",), ("Notes: a; Role: b",), ("a role",), (None,)], "t string")
    out = df.select(ledger.content(F.col("t"), ["notes", "role"]).alias("c"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    one, two, plain, none = (r["c"] for r in out.collect())
    assert one == two == "notesa\u0001roleb" and plain == "arole" and none is None


# 4 -------------------------------------------------------------------------------------------------

FINDER = personal.Finder(["Hollis", "Joren", "Kwame", "Hope", "Will", "Rose"], ["Price", "Ashgrove", "Marchetti-Rowe", "Köstermann"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to joren.pell@post.example or lotte(at)inbox.example now", [("email", "joren"), ("email", "lotte")]),
        ("mail abe_o [at] inbox [dot] example, please", [("email", "abe_o")]),
        ("Call (569) 555-0183 or +44 20 7946 0410 or 07700 900870.", [("phone", "(569"), ("phone", "+44"), ("phone", "07700")]),
        ("text 01 99 00 51 69", [("phone", "01")]),
        ("Invoice 2024-14-014 was paid, part 555-13-A, case file 202411107-003, ticket INC-2041-21602160", []),
        ("SSN 666-74-3729, no. QQ 91 45 67 C and QQ937996D, tax number 123456789", [("id_number", "666"), ("id_number", "QQ 91"), ("id_number", "QQ937"), ("id_number", "123")]),
        ("Our shed is 1348 Copperfield Way, the app", [("address", "1348")]),
        ("at 7 rue des Tilleuls Gris, ring", [("address", "7")]),
        ("is at Mühlenkehre 125b, ring; or Am Alten Deich 60a, or", [("address", "Mühlen"), ("address", "Am Alten")]),
        ("Hollis Ashgrove in accounting and Marchetti-Rowe, Kwame too", [("name", "Hollis"), ("name", "Marchetti")]),
        ("MY MANAGER HOLLIS Q. KÖSTERMANN SAID", [("name", "HOLLIS")]),
        ("in 150 ways this way or that, near Quillan County", []),
        ("I will look into the rose garden. Hope is no plan. The price rose.", []),
        ("Rose Price and Will Ashgrove came, so did Hope Price", [("name", "Rose Price"), ("name", "Will Ashgrove"), ("name", "Hope Price")]),
        ("The joren we met, ashgrove said", []),
        ("", []),
    ],
)
def test_personal_information(text, want):
    assert [(k, s) for s, _, k in FINDER.find(text)] == [(k, text.index(x)) for k, x in want]


def test_redaction_and_surrogates(spark):
    rows = [
        (1, "Ask Hollis Ashgrove, hollis@post.example. Ashgrove, Hollis again: (569) 555-0183", "by Hollis Ashgrove"),
        (2, "HOLLIS ASHGROVE and Benedikt Ashgrove", "u/someone"), (3, None, None), (4, "", "Hollis Ashgrove"), (4, "nothing here", None),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, text string, author string").withColumn("edits", F.lit(1))
    names = (["Hollis", "Benedikt"], ["Ashgrove"])
    out = {(r["row_id"], r["text"], r["author"]) for r in personal.redacted(df, names).collect()}
    assert (1, "Ask [NAME], [EMAIL]. [NAME] again: [PHONE]", "by [NAME]") in out
    assert (3, None, None) in out and (4, "nothing here", None) in out and len(out) == 5
    found = personal.entities(df, names, with_text=True)
    drawn = personal.surrogates(found, b"k")
    rows = drawn.collect()
    assert len({(r["kind"], r["surrogate"]) for r in rows}) == len(rows) == len({(r["kind"], r["canon"]) for r in rows})
    assert {(r["kind"], r["canon"]) for r in rows if r["kind"] in ("given", "family")} == {("given", "hollis"), ("given", "benedikt"), ("family", "ashgrove")}
    put = {(r["kind"], r["canon"]): r["surrogate"] for r in rows}
    hollis, ashgrove, benedikt = put["given", "hollis"], put["family", "ashgrove"], put["given", "benedikt"]
    out = {(r["row_id"], r["text"], r["author"]) for r in personal.replaced(df, names, drawn, b"k").collect()}
    assert (2, f"{hollis.upper()} {ashgrove.upper()} and {benedikt} {ashgrove}", "u/someone") in out
    assert (4, "", f"{hollis} {ashgrove}") in out and (3, None, None) in out and (4, "nothing here", None) in out
    one = next(t for i, t, _ in out if i == 1)
    assert one.startswith(f"Ask {hollis} {ashgrove}, ") and f" {ashgrove}, {hollis} again: (569) " in one and "555-0183" not in one


def test_a_hundred_thousand_lone_names(spark):
    found = spark.range(100_000).select(F.lit("name").alias("kind"), F.concat(F.hex("id"), F.lit("name|")).alias("canon"))
    drawn = personal.surrogates(found, b"k")
    assert drawn.count() == 100_000 == drawn.select("surrogate").distinct().count()


def test_surrogates_keep_gender_and_script():
    draw = lambda kind, canon: personal.surrogate_of(kind, canon, 0, b"k")
    assert draw("given", "anna").endswith("a") and not draw("given", "john").endswith("a")
    assert personal.script_of(draw("given", "ольга")) == personal.script_of(draw("family", "иванов")) == "cyrillic"
    assert [personal.script_of(draw("family", w)) for w in ("παπας", "王", "كريم", "김")] == ["greek", "han", "arabic", "hangul"]
    assert personal.gender("benedikt") == "m" and personal.gender("qwertz") == "u"


def test_names_beyond_the_automaton(spark, monkeypatch):
    monkeypatch.setattr(personal, "MOST_NAMES", 2)
    authors = [f"{g} {f}" for g in ("Anna", "Berta", "Zelko") for f in ("Ashgrove", "Birnbaum", "Zylka")] * 2
    df = spark.createDataFrame([(i, None, a) for i, a in enumerate(authors)], "row_id bigint, text string, author string")
    given, family, more = personal.learn_names(df)
    assert (given, family) == (["Anna", "Berta"], ["Ashgrove", "Birnbaum"]) and more
    finder = personal.Finder(given, family, more)
    assert [finder.find("we saw Zelko and Anna Zylka")[k][2] for k in (0, 1)] == ["name", "name"]
    assert finder.find("The zelko we saw") == []


def test_written_like():
    names = {("given", "hollis"): "Adela", ("family", "ashgrove"): "Bexcroft"}
    assert personal.written_like("name", "ASHGROVE, HOLLIS", names) == "BEXCROFT, ADELA"
    assert personal.written_like("name", "Hollis Q. Ashgrove", names) == "Adela A. Bexcroft"
    assert personal.written_like("phone", "(569) 555-0183", "5691112222") == "(569) 111-2222"
    assert personal.written_like("email", "a [at] b [dot] example", "x1@mail2.example") == "x1 [at] mail2 [dot] example"
    assert personal.written_like("address", "7 rue des Tilleuls Gris", "12 Elmdale") == "12 rue des Elmdale"
    assert personal.written_like("address", "Mühlenkehre 125b", "12 Elmdale") == "Elmdalekehre 12"


# 5 -------------------------------------------------------------------------------------------------


def test_clusters_of_planted_themes(spark):
    rng = random.Random(3)
    topics = [[f"{t}word{chr(97 + i)}" for i in range(26)] for t in "abcdefghijkl"]
    common = [f"filler{chr(97 + i)}" for i in range(26)]
    rows, truth = [], {}
    for i in range(1200):
        t = i % 12
        truth[i] = t
        rows.append((i, " ".join(rng.sample(topics[t], 3)), " ".join(rng.sample(topics[t], 8) + rng.sample(common, 12))))
    rows += [(5000, None, None), (5001, "", "[removed]")]
    df = spark.createDataFrame(rows, "row_id bigint, title string, text string").withColumn("terms", F.lit(1))
    t = themes.themes(df)
    got = {r["row_id"]: r["cluster"] for r in t.labels().collect()}
    assert t.k == 12
    assert got[5000] == got[5001] == -1
    pairs = [(a, b) for a, b in combinations(rng.sample(range(1200), 120), 2)]
    assert np.mean([(truth[a] == truth[b]) == (got[a] == got[b]) for a, b in pairs]) > 0.98


def test_a_subject_with_a_third_of_the_rows(spark):
    rng = random.Random(5)
    topics = [[f"{t}word{chr(97 + i)}" for i in range(26)] for t in "abcdefghijkl"]
    common = [f"filler{chr(97 + i)}" for i in range(26)]
    truth = {i: 0 if i % 3 == 0 else 1 + i % 11 for i in range(1500)}
    rows = [(i, " ".join(rng.sample(topics[t], 3)), " ".join(rng.sample(topics[t], 8) + rng.sample(common, 12))) for i, t in truth.items()]
    got = {r["row_id"]: r["cluster"] for r in themes.themes(spark.createDataFrame(rows, "row_id bigint, title string, text string"), 12).labels().collect()}
    pairs = list(combinations(rng.sample(range(1500), 150), 2))
    assert np.mean([got[a] == got[b] for a, b in pairs if truth[a] == truth[b]]) > 0.98
    assert np.mean([got[a] != got[b] for a, b in pairs if truth[a] != truth[b]]) > 0.98


def test_too_small_to_cluster(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, None)], "row_id bigint, title string, text string")
    assert {r["cluster"] for r in themes.themes(df).labels().collect()} == {-1}


# 6 -------------------------------------------------------------------------------------------------

FORM = ["Team size: 77; Role: clerk; Notes: it broke, again; Objects: 3 lists", "Notes: It broke again!\n- Objects: 3 lists\n- Role: clerk\n- Team size: 77", "ROLE CLERK | NOTES IT BROKE AGAIN | TEAM SIZE 77 | OBJECTS 3 LISTS"]


def test_contents(spark, tmp_path):
    texts = [
        ("Title", "Some text, here."), ("title!", "some TEXT here"), ("Some text here", "TITLE"), ("Title", "Some text there"), (None, "Titlesometexthere"),
        *[("Form", f) for f in FORM], ("Form", "Team size: 78; Role: clerk; Notes: it broke, again; Objects: 3 lists"),
        ("x", None), ("x", ""), ("x", "[removed]"), ("x", " [Deleted] "), ("x", "?!"), ("straße", "MASSE"), ("STRASSE", "masse"),
    ]
    df = frame(spark, [dict(row_id=i, batch_id=b, title=a, text=t) for i, (a, t) in enumerate(texts) for b in [i % 3 if i % 4 else None]])
    keys = ledger.content_keys(df, ["team size", "role", "notes", "objects"]).collect()
    by = defaultdict(set)
    for r in keys:
        by[r["key_hi"], r["key_lo"]].add(r["row_id"])
    none = by.pop((None, None))
    assert none == {9, 10, 11, 12, 13}
    assert {frozenset(v) for v in by.values()} == {frozenset(x) for x in ({0, 1, 2}, {3}, {4}, {5, 6, 7}, {8}, {14, 15})}


def test_ledger_grows_batch_by_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 7, 0) for i in range(100)], "row_id bigint, key_hi bigint, key_lo bigint")
    path = f"file://{tmp_path}/ledger"
    for k, part in enumerate(("row_id < 30", "row_id >= 30 and row_id < 31", "row_id < 0", "row_id >= 31")):
        # Each batch comes to a ledger that is opened anew, and comes twice.
        for _ in range(2):
            book = ledger.Ledger(spark, path, ["role"], buckets=3)
            book.apply(df.filter(part), f"batch {k}")
            assert book.labels == ["role"]
    got = {r["key_hi"]: (r["copies"], r["first_row_id"]) for r in ledger.Ledger(spark, path).contents().collect()}
    assert got == {k: (len(range(k, 100, 7)), k) for k in range(7)}


def test_ledger_touches_the_buckets_of_a_batch_only(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    book = ledger.Ledger(spark, path, [], buckets=64)
    book.apply(spark.range(2000).select(F.col("id").alias("row_id"), F.xxhash64("id").alias("key_hi"), F.col("id").alias("key_lo")))
    before = dict(book.state["at"])
    book.apply(spark.range(2000, 2003).select(F.col("id").alias("row_id"), F.xxhash64("id").alias("key_hi"), F.col("id").alias("key_lo")))
    moved = {b for b in before if book.state["at"][b] != before[b]}
    assert 1 <= len(moved) <= 3 and book.contents().count() == 2003


def test_two_writers_cannot_both_commit(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    df = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (None, 2, 2)], "row_id bigint, key_hi bigint, key_lo bigint")
    one, two = ledger.Ledger(spark, path), ledger.Ledger(spark, path)
    one.apply(df)
    with pytest.raises(Exception):
        two.apply(df)
    assert {(r["key_hi"], r["copies"], r["first_row_id"]) for r in ledger.Ledger(spark, path).contents().collect()} == {(1, 2, 1), (2, 1, None)}


# 8 -------------------------------------------------------------------------------------------------


def test_encoding_in_small_chunks(spark):
    vocabulary = f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}"
    rng = random.Random(6)
    pieces = ["don't ", "we'll", "  ", "\n\n", "übergrößen", "数据", "🐝", "x" * 70, " " * 70, "12345", "...", "<|endoftext|>", "а́", "\t"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([1, 5, 60]))) for _ in range(60)] + ["", None, " ", "a" * 500, " " * 500, "a" * 500]
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("piece", F.lit(1))
    got = encoding.encode_column(df, "doc_id", "text", vocabulary, chunk=64, overlap=24).collect()
    enc = encoding.encoder(vocabulary)
    want = sorted((i if i % 9 else -1, enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want
    by = {r["doc_id"]: r["ids"] for r in got if r["doc_id"] is not None}
    assert all(b"".join(enc.decode_single_token_bytes(t) for t in by[i]).decode() == (t or "") for i, t in enumerate(texts) if i % 9)


def test_long_texts_of_every_kind(spark):
    vocabulary = f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}"
    rng = random.Random(16)
    texts = ["".join(rng.choice("ab1 .'\nsé🐝") for _ in range(rng.randrange(20, 400))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = encoding.encoder(vocabulary)
    got = {r["doc_id"]: r["ids"] for r in encoding.encode_column(df, "doc_id", "text", vocabulary, chunk=20, overlap=8).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


# 9 -------------------------------------------------------------------------------------------------


def test_mixture_holds_its_shares(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None, "unlisted"]), rng.choice([0, 1, 5, 9])) for i in range(3000)] + [(7, "c", 4), (7, "c", 4)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("use", F.lit(9))
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.1, 9)], "source string, target_share double, repeat_cap int")
    mixture, report = mixing.queued(sized, targets)
    uses = mixture.collect()
    assert [u["finish"] for u in uses] == sorted(u["finish"] for u in uses)
    caps = {"a": 1, "b": 2, "c": 3}
    times = defaultdict(int)
    for u in uses:
        times[u["source"], u["doc_id"]] += 1
    assert all(n <= caps[s] * (3 if d == 7 else 1) for (s, d), n in times.items())
    shares = {r["source"]: r for r in report.collect()}
    for s, want in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(shares[s]["reached_share"] - want) < 0.01 and abs(shares[s]["weight"] - want) < 1e-6
    assert shares["none"]["used_tokens"] == 0
    total = {s: sum(n for _, x, n in rows if x == s) for s in caps}
    assert max(shares[s]["used_tokens"] / (total[s] * caps[s]) for s in caps) > 0.98
    small, _ = mixing.queued(sized, targets, budget=300)
    assert 280 <= sum(u["n_tokens"] for u in small.collect()) <= 300


def test_a_scarce_source_stops_at_its_cap(spark):
    sized = spark.createDataFrame([(i, "a", 5) for i in range(200)] + [(900, "b", 5)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, repeat_cap int")
    mixture, report = mixing.queued(sized, targets, budget=1000)
    got = {r["source"]: r for r in report.collect()}
    assert (got["a"]["used_tokens"], got["b"]["used_tokens"], got["b"]["most_uses"]) == (500, 15, 3)
    assert mixture.count() == 103 and got["b"]["reached_share"] < got["b"]["target_share"]
    filled, report = mixing.queued(sized, targets, budget=900, scarce="fill")
    got = {r["source"]: r for r in report.collect()}
    assert (got["a"]["used_tokens"], got["b"]["used_tokens"]) == (885, 15) and filled.count() == 180
    everything, report = mixing.queued(sized, targets, budget=5000, scarce="fill")
    assert {r["source"]: r["used_tokens"] for r in report.collect()} == {"a": 1000, "b": 15}


# 10 ------------------------------------------------------------------------------------------------

SOUND = "Größere Änderungen müssen übers Wochenende geschehen – «fin» 30 €, el año pasó así, Âge du système; “We’re” naïve. Pingüino, ação, È, œuvre."
MENDER = garbled.Mender()


@pytest.mark.parametrize("wrong", garbled.MISTAKEN)
def test_garbled_text_is_restored(wrong):
    seen = garbled._misread(SOUND.encode("utf-8"), wrong)
    found, back, n, kind, whole = MENDER.mend(seen)
    assert found and whole and n > 5 and back == SOUND


def test_garbled_piece_among_sound_text():
    piece = "Früher genügte ein Ordner."
    mixed = f"{SOUND} {piece.encode().decode('cp1252')} {SOUND}"
    assert MENDER.mend(mixed)[:2] == (True, f"{SOUND} {piece} {SOUND}")
    twice = f"{SOUND} {piece.encode().decode('cp1252').encode().decode('cp1252')} {SOUND}"
    assert MENDER.mend(twice)[:2] == (True, f"{SOUND} {piece} {SOUND}")


def test_one_byte_swap():
    text = "Für 248 hätten wir längst eine Lösung gekauft"
    assert MENDER.mend(text.encode("cp1252").decode("cp437"))[:2] == (True, text)


@pytest.mark.parametrize("wrong", ["cp437", "cp850"])
@pytest.mark.parametrize("text", ["wir hätten es längst gekauft", "das können wir nicht lösen", "es wurde natürlich zurück gelegt"])
def test_swap_to_ordinary_marks(text, wrong):
    assert MENDER.mend(garbled._misread(text.encode(wrong), "cp1252"))[:2] == (True, text)


@pytest.mark.parametrize("right, wrong", [("cp1252", "mac_roman"), ("mac_roman", "cp1252")])
def test_one_misread_letter(right, wrong):
    assert MENDER.mend(f"We met in the {garbled._misread('café'.encode(right), wrong)} today")[:2] == (True, "We met in the café today")


@pytest.mark.parametrize("text", ["We are ½ staffed", "wrote «fin» on it", "stay at 24°C ± 2", "last sheet, à la carte", "así se pierde"])
def test_signs_of_a_swap(text):
    assert MENDER.mend(text.encode("cp1252").decode("cp437"))[:2] == (True, text)


@pytest.mark.parametrize(
    "text",
    ["╔══╗\n║ a ║\n╚══╝", "│ name ░░▒▒ 40%", "α = 0.05", SOUND, None, "", "plain", "nÃO HÁ INFORMAÇÃO", "Θ = 42, Σx ≤ 9, Δt ≈ 3", "Заметка: ключ у гостя. Её ёлка, Він", "テスト 테스트 اختبار 仓库盘点每周一次。", "🐝📦 ok 👍🏽", "été (decomposed)",
     "Their feed showed “CafÃ©” where the café's name belongs", "had typed “â€™” for an apostrophe", "├── src\n│   └── a", "20°C ± 2", "MANHÃ” disse"],
)
def test_sound_text_stays(text):
    assert MENDER.mend(text) == (False, text, 0, None, True)


def test_garbled_references():
    seen = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in "Könnte it’s 30 °C".encode().decode("cp1252"))
    assert MENDER.mend(f"{seen} &#228; &amp; &eacute;")[:2] == (True, "Könnte it’s 30 °C &#228; &amp; &eacute;")
    assert MENDER.mend("K&#246;nnte &lt;b&gt; &Atilde; 5 &#176;C") == (False, "K&#246;nnte &lt;b&gt; &Atilde; 5 &#176;C", 0, None, True)


def test_lost_bytes():
    found, back, _, kind, whole = MENDER.mend("Qu� desastre")
    assert found and not whole and kind == "undecodable bytes"


def test_mended_keeps_every_row(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "cafÃ©"), (None, "fine"), (4, "x" * 200_000 + "cafÃ©")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("garbled", F.lit("clash"))
    out = garbled.mended(df).collect()
    assert len(out) == 6 and sum(r["garbled"] for r in out) == 2
    assert {r["doc_id"] for r in garbled.garbled_keys(df).collect()} == {3, 4}
