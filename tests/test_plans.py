import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from grainmill.operators import combining, packing, sampling
from grainmill.plans import compat, index, planner
from grainmill.streaming import filling, loader


def chunks(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "chunk long, size long")


def sequential(sizes, budgets):
    """Fill the workers in order with the chunks in order."""
    out, c, used = [], 0, 0
    for w, left in enumerate(budgets):
        while left > 0 and c < len(sizes):
            k = min(left, sizes[c] - used)
            if k > 0:
                out.append((w, c, used, used + k))
            left, used = left - k, used + k
            if used == sizes[c]:
                c, used = c + 1, 0
    return out


@settings(max_examples=5, derandomize=True, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8), st.integers(1, 3), st.integers(1, 3), st.integers(1, 5), st.booleans())
def test_assignment_is_the_sequential_fill(spark, sizes, world, workers, batch, drop):
    table = chunks(spark, sizes)
    budgets = [r["budget"] for r in planner.budgets(table, world, workers, batch, drop).orderBy("w").collect()]
    got = [(r["w"], r["chunk"], r["start"], r["end"]) for r in planner.plan(table, world, workers, batch, drop).orderBy("w", "pos").collect()]
    assert got == sequential(sizes, budgets)
    assert sum(budgets) == (sum(sizes) if not drop else sum(sizes) // batch // world * batch * world)


def test_golden_assignment(spark):
    plan = planner.plan(chunks(spark, [50, 150, 50, 12, 50, 27, 50, 33]), 4, 1, 1, True)
    assert {r["rank"]: r["n"] for r in planner.lengths(plan).collect()} == {0: 105, 1: 105, 2: 105, 3: 105}


def test_golden_orders():
    first, second = compat.node_order([list(range(8)), list(range(8, 16))], 42, 0)
    assert sorted(first) == list(range(8)) and sorted(second) == list(range(8, 16))
    assert compat.draws([0.5, 0.5], 4, 42) == compat.draws([1, 1], 4, 42)
    mix = compat.interleave([10, 10], [0.5, 0.5], 42, True)
    assert len(mix) == 20 and [p for s, p in mix if s == 0] == list(range(10))


def test_node_shuffle_lists_a_chunk_once(spark):
    plan = planner.plan(chunks(spark, [7] * 9), 4, 2, shuffle=True, num_nodes=2, epoch=3)
    read = plan.groupBy("chunk").agg({"end": "max"}).count()
    assert read == plan.select("chunk").distinct().count()
    assert sum(r["n"] for r in planner.lengths(plan).collect()) <= 63 + 7


@pytest.mark.parametrize(("sizes", "nodes", "drop", "missing"), [([10] * 9, 2, True, 2), ([10] * 9, 2, False, 0), ([7, 1, 30, 2, 11], 4, False, 0)])
def test_node_shuffle_reads_a_row_once(spark, sizes, nodes, drop, missing):
    """Chunks that nodes share are read in parts, in every epoch the same rows by the same node."""

    def read(epoch):
        plan = planner.plan(chunks(spark, sizes), 4, 2, drop_last=drop, shuffle=True, num_nodes=nodes, epoch=epoch)
        return [(r["w"] * nodes // 8, r["chunk"], i) for r in plan.collect() for i in range(r["start"], r["end"])]

    first, third = read(1), read(3)
    assert len(third) == len({x[1:] for x in third}) == sum(sizes) - missing
    assert sorted(first) == sorted(third)


def test_node_shuffle_keeps_regions(spark):
    rows = [(i, 10, 2, 9) for i in range(9)]
    table = spark.createDataFrame(rows, "chunk long, size long, roi_start long, roi_end long")
    plan = planner.plan(table, 4, 2, drop_last=False, shuffle=True, num_nodes=2, epoch=3).collect()
    assert sorted((r["chunk"], i) for r in plan for i in range(r["start"], r["end"])) == [(c, i) for c in range(9) for i in range(2, 9)]


def test_epochs_permute_and_cover(spark):
    orders = [[r["chunk"] for r in planner.shuffled(chunks(spark, [3] * 20), 1, e).orderBy("ord").collect()] for e in (1, 2)]
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1]) == list(range(20))


def test_positions_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(index, "RANGE_ROWS", 100)
    rows = index.with_position(spark.range(1000).selectExpr("1000 - id k"), "k")
    assert rows.where("idx <> k - 1").count() == 0 and rows.count() == 1000


def test_greedy_chunks():
    assert packing.greedy([504, 10004, 154, 204], 9000).tolist() == [0, 1, 2, 2]
    assert packing.greedy([36] * 4, 90).tolist() == [0, 0, 1, 1]


def test_largest_first():
    bins = packing.largest_first([4, 1, 2, 5, 8, 7, 3, 6, 9], 3)
    weights = [sum(w for w, b in zip([4, 1, 2, 5, 8, 7, 3, 6, 9], bins, strict=True) if b == k) for k in range(3)]
    assert sorted(weights) == [14, 15, 16]
    with pytest.raises(ValueError):
        packing.largest_first([1, 0], 2)


def brute_bins(rows, bins):
    totals, out = [0] * bins, {}
    for k, w in sorted(rows, key=lambda r: (-r[1], r[0])):
        out[k] = totals.index(min(totals))
        totals[out[k]] += w
    return out


@pytest.mark.parametrize("most", [0, 1000])
def test_balanced_packs_all_items(spark, monkeypatch, most):
    monkeypatch.setattr(packing, "DRIVER_ITEMS", most)
    monkeypatch.setattr(index, "RANGE_ROWS", 40)
    for bins, weights in ((4, [1 + i * i % 13 for i in range(300)]), (3, [1000, 70, 70, 3, *[1] * 90]), (7, [5, 5])):
        rows = [(500 - i, w) for i, w in enumerate(weights)]
        got = packing.balanced(spark.createDataFrame(rows, "k long, w int").repartition(3), "w", bins, "k")
        assert got.columns == ["k", "w", "bin"] and {r["k"]: r["bin"] for r in got.collect()} == brute_bins(rows, bins)


def test_lpt_of_the_whole_table(spark, sf_dir):
    from grainmill import catalogue

    parts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").collect()]
    assert {r["p_partkey"]: r["bin"] for r in catalogue.q_lpt_whole(spark, sf_dir).collect()} == brute_bins(parts, 4)


@pytest.mark.parametrize(("workers", "sizes"), [(1, [5]), (2, [2, 3]), (3, [1, 2, 2]), (4, [1, 1, 1, 2])])
def test_sequential_split(spark, workers, sizes):
    got = packing.split_evenly(spark.range(5).withColumnRenamed("id", "idx"), workers).groupBy("worker").count().orderBy("worker").collect()
    assert [r["count"] for r in got] == sizes


def test_subsample_of_regions(spark):
    rows = [(i, n, 0, n) for i, n in enumerate([50, 25, 75, 35, 5])]
    table = spark.createDataFrame(rows, "chunk long, size long, roi_start long, roi_end long")
    assert sampling.subsample(table, 0.42).selectExpr("sum(end - start)").first()[0] == 79


def test_splits(spark):
    got = sampling.split(chunks(spark, [10] * 20), [0.1, 0.2, 0.7, 0.0], 3).selectExpr("part", "end - start n").groupBy("part").sum("n").collect()
    assert {r["part"]: r["sum(n)"] for r in got} == {0: 20, 1: 40, 2: 140}
    for wrong in ([0.7, 0.7], [1], [-0.1]):
        with pytest.raises(ValueError):
            sampling.split(chunks(spark, [10]), wrong)
    for wrong in (1, 0.0, -1.0):
        with pytest.raises(ValueError):
            sampling.subsample(chunks(spark, [10]), wrong)


def test_mix_refuses_weights_for_all(spark):
    with pytest.raises(ValueError):
        combining.mixed(spark.range(3).selectExpr("id", "1 s"), "s", {1: 1.0}, "id")


def test_replay_is_the_loop(spark):
    def loop(n, batch, workers):
        used, w = [0] * workers, 0
        while n > 0:
            used[w % workers] += min(batch, n)
            n, w = n - batch, w + 1
        return used

    for batch, workers in ((4, 2), (5, 3), (8, 3)):
        rows = spark.range(40).selectExpr("id n", f"explode(sequence(0, {workers - 1})) w")
        got = rows.select("n", "w", loader.consumed(rows["n"], rows["w"], workers, batch).alias("u")).collect()
        assert all(r["u"] == loop(r["n"], batch, workers)[r["w"]] for r in got)


def test_state_is_checked():
    saved = loader.state(10, 1, seed=42, shuffle=True)
    assert loader.checked(saved, {"seed": 42, "shuffle": True}, 20) == []
    with pytest.raises(ValueError):
        loader.checked(saved, {"seed": 1}, 20)
    assert loader.checked(saved, {"seed": 1}, 5, override=True)


@pytest.mark.parametrize(
    ("n", "ranks", "expected"),
    [
        (21, 1, [[0, 1, 2], [7, 8, 9], [14, 15, 16], [3, 4, 5], [10, 11, 12], [17, 18, 19], [6], [13], [20]]),
        (11, 1, [[0, 1, 2], [3, 4, 5], [6, 7, 8], [], [], [9, 10]]),
        (8, 1, [[0, 1], [2, 3], [4, 5, 6], [], [], [7]]),
        (4, 1, [[0], [1], [2, 3]]),
        (19, 1, [[0, 1, 2], [6, 7, 8], [12, 13, 14], [3, 4, 5], [9, 10, 11], [15, 16, 17], [], [], [18]]),
        (19, 2, [[0, 1, 2], [3, 4, 5], [6, 7, 8]]),
    ],
)
def test_filling_batches(spark, n, ranks, expected):
    rows = filling.filling_batches(spark.range(n).toDF("idx"), n, ranks, 3, 3).where("rank = 0").collect()
    assert [sorted(r["idx"] for r in rows if r["batch"] == b) for b in range(max(r["batch"] for r in rows) + 1)] == expected


def test_filled_batches_keep_chunks_whole(spark):
    sizes = [5, 3, 0, 7, 1]
    data = spark.createDataFrame([(c, r) for c, n in enumerate(sizes) for r in range(n)], "chunk long, row long")
    for ranks in (1, 2, 7):
        rows = filling.filled_batches(data, chunks(spark, sizes), ranks, 2, 3).collect()
        assert sorted((r["chunk"], r["row"]) for r in rows) == sorted((r["chunk"], r["row"]) for r in data.collect())
        for w in {(r["rank"], r["worker"]) for r in rows}:
            mine = sorted((r for r in rows if (r["rank"], r["worker"]) == w), key=lambda r: r["place"])
            assert [r["place"] for r in mine] == list(range(len(mine)))
            turns = [r["chunk"] for i, r in enumerate(mine) if i == 0 or mine[i - 1]["chunk"] != r["chunk"]]
            assert len(turns) == len(set(turns))
            assert all(r["batch"] == r["place"] // 3 * 2 + w[1] for r in mine)


def test_a_read_goes_on_where_it_stopped(spark):
    rows = spark.createDataFrame([(w, i + 1, 100 * w + i) for w in range(3) for i in range(8)], "w long, rn long, x long")
    turns = lambda r: (r["batch"], r["rn"])
    whole = [r["x"] for r in sorted(loader.batches(rows, 4).collect(), key=turns)]
    for n in (0, 3, 4, 9, 20, 24):
        left = sorted(loader.going_on(rows, n, 3, 4).collect(), key=turns)
        assert [r["x"] for r in left] == whole[n:]
        assert not left or (left[0]["batch"], left[0]["turn"]) == (0, 0)
    first = loader.collated(loader.batches(rows, 4), ["x"]).orderBy("batch").first()
    assert (first["batch"], first["n"], first["x"]) == (0, 4, [0, 1, 2, 3])
