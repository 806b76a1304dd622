import random

from tessera.llm.packing import fill_containers, fill_report, mixed_windows, pack, split_items
from tessera.llm.running import running_totals
from tessera.llm.tokens import with_tokens

LIMITS = [("small", 50), ("large", 200), (None, 10), ("none", 0)]


def frames(spark, n=3000):
    random.seed(0)
    rows = [(i, random.choice("aaabc") if i % 40 else None, random.randint(1, 60) if i % 100 else 730) for i in range(n)] + [(n, "a", 0), (n + 1, "a", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), spark.createDataFrame(LIMITS, "container_kind string, capacity_tokens int")


def test_running_totals_against_a_loop(spark):
    random.seed(1)
    rows = [(random.choice("xy"), i, random.choice([1, 2, None])) for i in range(2000)]
    random.shuffle(rows)
    got = {(r.g, r.o): r.before for r in running_totals(spark.createDataFrame(rows, "g string, o long, v long"), ["g"], "o", "v").collect()}
    sums = {"x": 0, "y": 0}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        assert got[g, o] == sums[g]
        sums[g] += v or 0


def test_every_token_is_packed_once_and_fits(spark):
    sized, limits = frames(spark)
    packed = pack(sized, limits, {"a": 0.5, "b": 0.5, "unknown": 1.0}, containers=16).toPandas()
    assert set(packed.container_kind) == {"small", "large"}
    for kind, own in packed.groupby("container_kind"):
        capacity = dict(LIMITS)[kind]
        assert own.groupby(["window", "container"])["size"].sum().max() <= capacity
        sizes = {r.doc_id: r.n_tokens for r in sized.where("n_tokens > 0").collect()}
        assert own.groupby("doc_id")["size"].sum().to_dict() == sizes
        pieces = own.groupby("doc_id")["piece"].count()
        assert all(pieces[d] == -(-n // capacity) for d, n in sizes.items())
    report = {r.container_kind: r.filled for r in fill_report(pack(sized, limits, {"a": 1.0}, containers=64)).collect()}
    assert report["large"] > 0.95 and report["small"] > 0.85


def test_windows_hold_the_target_mix(spark):
    sized, limits = frames(spark, 6000)
    pieces = split_items(sized.where("source IS NOT NULL"), limits.where("container_kind = 'large'"))
    windows = mixed_windows(pieces, {"a": 0.2, "b": 0.4, "c": 0.4}, containers=32).toPandas()
    first = windows[windows.window < 5].groupby(["window", "source"])["size"].sum().unstack()
    shares = first.div(first.sum(axis=1), axis=0)
    assert abs(shares["a"] - 0.2).max() < 0.05 and abs(shares["b"] - 0.4).max() < 0.07


def test_empty_and_tokens(spark):
    sized, limits = frames(spark, 10)
    assert pack(sized.limit(0), limits, {"a": 1.0}).count() == 0 and pack(sized, limits.limit(0), {"a": 1.0}).count() == 0
    assert fill_containers(mixed_windows(split_items(sized, limits), {})).count() > 0
    df = spark.createDataFrame([(None,), ("",), ("Tòa án nhân dân",), ("a " * 50_000,)], "text string")
    counts = [r.n_tokens for r in with_tokens(df, "text").collect()]
    assert counts[0] is None and counts[1] == 0 and counts[2] > 3 and counts[3] >= 50_000
