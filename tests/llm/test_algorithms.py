import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from newsloom.llm import capping, headlines, history, mixing, packing


def test_capping_equals_a_sort(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(-3, 4)]), "x") for i in range(600)] + [(1, "a", 3, "x")]
    df = spark.createDataFrame(rows, "id long, g string, score int, _key string").withColumn("lim", F.when(F.col("g") == "b", F.lit(None)).otherwise(F.lit(20)))
    got = capping.rank_rows(df, ["g"], "lim", "score", "id")
    assert set(got.columns) == {"id", "g", "score", "_key", "lim", "over_limit"}
    over = sorted(x["id"] for x in got.where("over_limit").collect())
    want = []
    for g in ("a", None):
        mine = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
        cut = mine[19]
        want += [x[0] for x in mine if (x[2] is None, -(x[2] or 0), x[0]) > (cut[2] is None, -(cut[2] or 0), cut[0])]
    assert over == sorted(want)


def test_capping_edges(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None)], "id long, g string, score int")
    assert capping.rank_rows(df.where("false"), ["g"], F.lit(1), "score", "id").count() == 0
    assert capping.rank_rows(df, ["g"], F.lit(0), "score", "id").where("over_limit").count() == 2
    assert capping.rank_rows(df, ["g"], F.lit(None), "score", "id").where("over_limit").count() == 0
    assert {x["share_limit"] for x in capping.share_limits(df, ["g"], 0.5).collect()} == {1}


def test_fullest_equals_brute_force():
    r = random.Random(2)
    for _ in range(200):
        sizes = [r.randrange(1, 40) for _ in range(r.randrange(1, 9))]
        room = r.randrange(1, 120)
        best = max((s for s in (sum(x for k, x in enumerate(sizes) if m >> k & 1) for m in range(1 << len(sizes))) if s <= room))
        counts = {x: sizes.count(x) for x in sizes}
        got = packing.fullest(room, sorted(counts, reverse=True), counts)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_packing(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(0, 900)) for i in range(300)] + [(900, 2500), (901, None), (1, 5), (902, 1000)]
    items = spark.createDataFrame([(i, n, "z") for i, n in rows], "doc_id long, tokens long, bin_id string")
    caps = spark.createDataFrame([("k", 1000), ("n", None)], "kind string, capacity_tokens int")
    got = packing.pack(items, caps, shard_items=80).collect()
    bins = {}
    for x in got:
        bins.setdefault(x["bin_id"], []).append(x["tokens"])
    assert all(sum(v) <= 1000 for v in bins.values())
    assert sum(x["tokens"] for x in got) == sum(n or 0 for _, n in rows)
    assert {x["doc_id"] for x in got if x["pieces"] > 1} == {900}
    assert len(bins) <= 1.05 * sum(n or 0 for _, n in rows) / 1000 + 2
    assert packing.pack(items.where("false"), caps).count() == 0 and packing.pack(items, caps.where("false")).count() == 0


def test_mixing(spark):
    r = random.Random(4)
    docs = [(i, s, r.randrange(20, 300)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 400 + ["few"] * 60)] + [(9999, "big", None), (9998, None, 10), (9997, "few", 0)]
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, source string, tokens long, copies string").repartition(5)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("few", 0.1, 4), ("gone", 0.1, 3)], "source string, target_weight double, max_repeats int")
    mixed = mixing.mix(df, targets)
    assert mixed.where("source is not null").count() == 3462
    got = {x["source"]: x for x in mixing.shares(mixed, targets).collect()}
    assert got["gone"]["actual_share"] == 0 and all(x["most_copies"] <= x["max_repeats"] for x in got.values())
    for s, w in (("big", 0.5), ("mid", 0.3), ("few", 0.1)):
        assert abs(got[s]["actual_share"] - w / 0.9) < 0.01
    assert mixing.mix(df.where("false"), targets).count() == 0 and mixing.mix(df, targets.where("false")).count() == 0


def test_pivotal_step_keeps_mass():
    r = random.Random(5)
    for _ in range(300):
        i, j = ({"tokens": r.randrange(1, 50), "p": r.random(), "doc_id": k} for k in (1, 2))
        mass = i["tokens"] * i["p"] + j["tokens"] * j["p"]
        done, left = mixing.settle(i, j, r.random())
        assert done["p"] in (0.0, 1.0)
        assert left is None or abs(i["tokens"] * i["p"] + j["tokens"] * j["p"] - mass) < 1e-6


def brute(rows, names):
    weight = np.full(headlines.CLASSES, 5.0, np.float32)
    told, out = [], {}
    for i, t, u in rows:
        raw, cut = headlines.plain_title(t)
        raw = headlines.strip_site(raw, names)
        f, k = headlines.fold(raw), history.page_key(u)
        g = headlines.vectors([f])[1]
        hit = next((a for a, r2, f2, c2, k2, g2 in told if (k and k == k2) or (f and f2 and (f == f2 or headlines.same_story(f, f2, g, g2, raw, r2, cut, c2, weight)))), None)
        if hit is None:
            told.append((i, raw, f, cut, k, g))
        else:
            out[i] = hit
    return out


ROWS = [
    (1, "Alpha Labs unveils Zorban Kelu 1.2 for low-latency code repair with open weights", "https://a.test/1"),
    (2, "UPDATE: Alpha Labs unveils Zorban Kelu 1.2 for low-latency code repair with open weights", "https://b.test/1"),
    (3, "Alpha Labs unveils Zorban Kelu 1.3 for low-latency code repair with open weights", "https://a.test/2"),
    (4, "Alpha Labs unveils Zorban Kelu 1.2 for low-latnecy code repair with open weights - Beta Blog", "https://c.test/9"),
    (5, "Something else entirely about a very different topic", "http://www.a.test/1/?utm_source=x"),
    (6, "Alpha Labs unveils Mitroval Sabe 1.2 for low-latency code repair with open weights", "https://a.test/4"),
    (7, "Alpha Labs unveils Zorban Kelu 1.2 for low-latency code repair…", "https://d.test/1"),
    (8, None, None), (9, None, None), (10, "", "https://a.test/4"), (11, "Gufifu用Kutivunir Kegi把多语种文档解析成本降低2%", "https://e.test/1"), (12, "Rodesu用Semikugos Sobre把多语种文档解析成本降低2%", "https://e.test/2"), (13, "Gufifu用Kutivunir Kegi把多语种文档解析成本降低2%", "https://e.test/3"),
]


def test_history(spark):
    names = frozenset({"Beta Blog"})
    df = spark.createDataFrame([(*x, x[0] // 4, "c") for x in ROWS], "row_id long, title string, url string, batch int, u string")
    for shares in ((), (0.3, 0.7)):
        got = {x["row_id_b"]: x["row_id_a"] for x in history.repeats(spark, df, "batch", names, shares).collect()}
        assert got == brute(ROWS, frozenset({"beta blog"})) == {2: 1, 4: 1, 5: 1, 7: 1, 10: 6, 13: 11}
    index = history.HistoryIndex(spark, names)
    assert index.ingest(df.where("false")).count() == 0


def test_history_keeps_links_between_blocks(spark):
    told, again = ROWS[0][1], ROWS[3][1].removesuffix(" - Beta Blog")
    first = spark.createDataFrame([(1, told, "https://a.test/1"), (2, again, "https://b.test/1")], "row_id long, title string, url string")
    second = spark.createDataFrame([(3, again, "https://c.test/7"), (4, again, "https://b.test/1"), (5, "Another story without any match", "https://d.test/1")], first.schema)
    index = history.HistoryIndex(spark)
    assert [tuple(x) for x in index.ingest(first).collect()] == [(1, 2)]
    # the headline was rejected in the first block: no accepted row has it, and it isn't new
    assert sorted(tuple(x) for x in index.ingest(second).collect()) == [(1, 3), (1, 4)]


def test_history_takes_rows_without_order(spark):
    df = spark.createDataFrame([(*x, None if x[0] in (1, 4, 13) else x[0] // 4) for x in ROWS], "row_id long, title string, url string, batch int")
    got = {x["row_id_b"]: x["row_id_a"] for x in history.repeats(spark, df, "batch", frozenset({"Beta Blog"}), (0.5,)).collect()}
    assert got == {2: 1, 4: 1, 5: 1, 7: 1, 10: 6, 13: 11}


def test_history_opens_again(spark, tmp_path):
    told, again = ROWS[0][1], ROWS[3][1].removesuffix(" - Beta Blog")
    schema = "row_id long, title string, url string"
    path = f"file://{tmp_path}/index"
    many = [(i, f"Story number {i} about {w} tuning in a {v} cluster", f"https://a.test/{i}x") for i, (w, v) in enumerate(((a, b) for a in "cache router prompt kernel".split() for b in "small large shared quiet".split()), 10)]
    history.HistoryIndex(spark, path=path).ingest(spark.createDataFrame([(1, told, "https://a.test/1"), *many], schema))
    size = sum(f.stat().st_size for f in (tmp_path / "index").rglob("*.parquet"))
    # another run opens the folder and finds what is there, by headline, by page and by a near headline
    index = history.HistoryIndex(spark, path=path)
    assert index.blocks == [0] and index.weight is not None
    second = spark.createDataFrame([(91, told, "https://x.test/1"), (92, again, "https://y.test/1"), (93, "Quite another headline here", "https://a.test/1"), (94, "Entirely new words of no relation", "https://z.test/1")], schema)
    assert sorted(tuple(x) for x in index.ingest(second).collect()) == [(1, 91), (1, 92), (1, 93)]
    # what was there was not written again, and a block that was never listed is not read
    assert sum(f.stat().st_size for f in (tmp_path / "index").rglob("block=0/**/*.parquet")) <= size
    assert history.HistoryIndex(spark, path=path).blocks == [0, 1]
    # few keys ask for few slots only
    near = index._near_keys("taken", "hub binary, row long", "hub", spark.createDataFrame([(bytearray(b"k"),)], "hub binary"), 1)
    assert len({f.split("slot=")[1].split("/")[0] for f in near.inputFiles()}) <= history.SLOTS and "PartitionFilters" in near._jdf.queryExecution().toString()


def test_packed_vectors_round_trip():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << headlines.DIM_BITS, n)) for n in (0, 1, 7, 84, 0, 300)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    packed = history._packed(starts, np.concatenate(sets))
    assert all((history._vector(p) == s).all() for p, s in zip(packed, sets))
    got = history._unpacked(packed)
    assert (got[0] == starts).all() and (got[1] == np.concatenate(sets)).all()


def test_rounds_decide_like_one_task(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, f"Story {r.choice('abcdefgh')} of the {r.choice(['quiet', 'loud'])} house and its many rooms", f"https://a.test/{r.randrange(25)}") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, title string, url string")
    accepted = lambda got: {i for i, *_ in rows} - {x["row_id_b"] for x in got}
    whole = accepted(history.HistoryIndex(spark).ingest(df).collect())
    monkeypatch.setattr(history, "FEW", 0)
    assert accepted(history.HistoryIndex(spark).ingest(df).collect()) == whole and len(whole) < 5


def test_hot_cells_are_split(spark, monkeypatch):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "reward", "kernel", "cache", "router"]
    rows = [(i, "Zorban " + " ".join(r.choices(words, k=5)), f"https://a.test/{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, title string, url string")
    whole = sorted(tuple(x) for x in history.HistoryIndex(spark).ingest(df).collect())
    monkeypatch.setattr(history, "HOT", 3)
    assert sorted(tuple(x) for x in history.HistoryIndex(spark).ingest(df).collect()) == whole


def test_slots_one_by_one_find_the_same(spark, monkeypatch):
    r = random.Random(11)
    words = ["".join(r.choices("bcdfgklmnprstvz", k=9)) for _ in range(20)]
    rows = [(i, " ".join(r.sample(words, 6)), f"https://a.test/{i}", i // 100) for i in range(250)]
    rows += [(i + 500, t + "s" if i % 2 else t[:-3] + "…", f"https://b.test/{i}", 2) for i, t, *_ in rows[:20]]
    df = spark.createDataFrame(rows, "row_id long, title string, url string, batch int")
    told = lambda got: sorted(tuple(x) for x in got.collect())
    whole = told(history.repeats(spark, df, "batch", frozenset(), (0.5,)))
    assert len(whole) >= 20
    # nothing is carried, every slot is worked through for itself
    monkeypatch.setattr(history, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(history, "SLICE_BYTES", 1)
    assert told(history.repeats(spark, df, "batch", frozenset(), (0.5,))) == whole


def test_a_step_moves_a_slots_share_of_the_postings(spark, monkeypatch):
    r = random.Random(12)
    words = ["".join(r.choices("bcdfgklmnprstvz", k=9)) for _ in range(20)]
    rows = [(i, "Zorban " + " ".join(r.sample(words, 6)), f"https://a.test/{i}", i // 100) for i in range(250)]
    rows += [(i + 500, t + "s" if i % 2 else t[:-3] + "…", f"https://b.test/{i}", 2) for i, t, *_ in rows[:20]]
    df = spark.createDataFrame(rows, "row_id long, title string, url string, batch int")
    told = lambda got: sorted(tuple(x) for x in got.collect())
    monkeypatch.setattr(history, "HOT", 3)
    whole = told(history.repeats(spark, df, "batch", frozenset(), (0.5,)))
    assert len(whole) >= 20
    asked, pairs = [], history.HistoryIndex._pairs
    monkeypatch.setattr(history.HistoryIndex, "_pairs", lambda self, slots, *more: asked.append(slots) or pairs(self, slots, *more))
    # each block has more than 600 and less than 10,000 postings of 50 bytes
    monkeypatch.setattr(history, "SLICE_BYTES", 120_000)
    assert told(history.repeats(spark, df, "batch", frozenset(), (0.5,))) == whole
    assert asked == [[s] for s in range(history.SLOTS)] * 2


def test_pairs_that_share_too_little_are_told_at_once():
    r = random.Random(13)
    words = ["".join(r.choices("bcdfgklmnprstvz", k=6)) for _ in range(8)]
    texts = [" ".join(r.sample(words, r.randint(1, 6))) for _ in range(400)]
    packed = pd.Series(history._packed(*headlines.vectors(texts)))
    p, q = packed[:200], packed[200:]
    share = [(2 * len(np.intersect1d(a, b)), headlines.SIMILAR * (len(a) + len(b))) for a, b in zip(map(history._vector, p), map(history._vector, q))]
    got = history._may_tell(p, q, np.zeros(200, dtype=bool))
    assert got.tolist() == [x >= y for x, y in share] and 0 < got.sum() < 200
    assert history._may_tell(p, q, np.ones(200, dtype=bool)).all() and not len(history._may_tell(p[:0], q[:0], np.zeros(0, dtype=bool)))


def test_cells_find_all_within_the_radius():
    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "reward", "kernel", "cache", "router", "prompt", "token", "vector", "sparse"]
    texts = [" ".join(r.choices(words, k=7)) for _ in range(120)]
    weight = np.random.default_rng(1).uniform(0.5, 3, headlines.CLASSES).astype(np.float32)
    starts, dims = headlines.vectors(texts)
    who, cell = headlines.cells_of(starts, dims, headlines.Weights(weight))
    sign = headlines.signatures(starts, dims).view(np.uint64)
    sets = [dims[a:b] for a, b in zip(starts[:-1], starts[1:])]
    cells = [set(cell[who == i].tolist()) for i in range(len(texts))]
    length = lambda d: (weight[d & (headlines.CLASSES - 1)].astype(float) ** 2).sum()
    for i in range(len(texts)):
        for j in range(i):
            both = np.intersect1d(sets[i], sets[j])
            # within the radius: what either side lacks of the other is at most that share of its squared length
            if length(both) >= (1 - headlines.RADIUS) * max(length(sets[i]), length(sets[j])):
                assert cells[i] & cells[j], (texts[i], texts[j])
            # the signature never tells more difference than there is
            assert np.bitwise_count(sign[i] ^ sign[j]).sum() <= len(sets[i]) + len(sets[j]) - 2 * len(both)
