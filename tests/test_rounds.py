"""Plans in passes, rules with versions and intervals, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.operators import evals, resweep, rounds
from hirelake.plans.views import Registry, whole


def in_turn(pairs):
    """Roles choose one after another."""
    best = {}
    for role, turn, job, rank in pairs:
        if role is not None and job is not None:
            t, r = best.get((role, job), (turn, rank))
            best[role, job] = (min(t, turn), min(r, rank))
    turns, lists = {}, {}
    for (role, job), (turn, rank) in best.items():
        turns[role] = min(turn, turns.get(role, turn))
        lists.setdefault(role, []).append((rank, job))
    taken, out = set(), []
    for role in sorted(turns, key=lambda x: (turns[x], x)):
        for rank, job in sorted(lists[role]):
            if job not in taken:
                taken.add(job)
                out.append((role, job, rank))
                break
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_assigned_against_turns(spark, seed):
    r = random.Random(seed)
    n = r.choice([6, 20, 40])
    pairs = [(r.randint(0, n), r.choice([0, 0, 1, 7]), r.randint(100, 100 + n), r.randint(1, 3)) for _ in range(n * r.choice([1, 3, 8]))]
    pairs = [(role, role % 3, job, rank) for role, _, job, rank in pairs]  # many roles have one turn
    pairs += pairs[:4] + [(None, 0, 100, 1), (1, 0, None, 1)]
    got = rounds.assigned(spark.createDataFrame(pairs, "role int, turn int, job int, rank int")).collect()
    assert sorted(map(tuple, got)) == in_turn(pairs)


def test_equal_lists_take_few_passes(spark, monkeypatch):
    """Forty roles that want the same forty jobs in the same order: one after another would be forty passes."""
    passes = []
    loop = rounds.until_stable
    monkeypatch.setattr(rounds, "until_stable", lambda *a: passes.append(loop(*a)) or passes[-1])
    pairs = [(role, role, job, 1) for role in range(40) for job in range(40)]
    got = rounds.assigned(spark.createDataFrame(pairs, "role int, turn int, job int, rank int")).collect()
    assert sorted(map(tuple, got)) == [(i, i, 1) for i in range(40)] and passes[0][1] == 0


@pytest.mark.parametrize("seed", range(3))
def test_assigned_with_shared_lists(spark, monkeypatch, seed):
    """Many roles have one of three lists, others a list of their own that crosses them."""
    monkeypatch.setattr(rounds, "MANY", 2)
    r = random.Random(seed)
    lists = [[(100 + r.randint(0, 20), r.randint(1, 2)) for _ in range(r.randint(1, 9))] for _ in range(3)]
    pairs = [(role, role * 7 % 5, job, rank) for role in range(30) for job, rank in (lists[role % 3] if role % 4 else [(100 + r.randint(0, 20), 1) for _ in range(3)])]
    got = rounds.assigned(spark.createDataFrame(pairs, "role int, turn int, job int, rank int")).collect()
    assert sorted(map(tuple, got)) == in_turn(pairs)


def test_passes_carry_who_moves(spark, monkeypatch):
    """A hundred roles of which one after another is sent on by one that comes earlier: the others rest."""
    sizes = []
    keep = rounds.written
    monkeypatch.setattr(rounds, "written", lambda df, name="state": (out := keep(df, name), sizes.append(out.count()) if name == "state" else None)[0])
    pairs = [(role, role, job, 1) for role in range(100) for job in (role, role + 1000)] + [(-3, -3, 1, 1), (-2, -2, 1, 1), (-2, -2, 2, 2)]
    got = rounds.assigned(spark.createDataFrame(pairs, "role int, turn int, job int, rank int")).collect()
    assert sorted(map(tuple, got)) == in_turn(pairs)
    assert sizes[0] == 102 and max(sizes[1:]) == 2


def test_assigned_empty(spark):
    assert rounds.assigned(spark.createDataFrame([], "role int, turn int, job int, rank int")).count() == 0


def test_until_stable_ends_or_raises(spark):
    start = spark.range(5).withColumns({"n": F.lit(0), "moved": F.lit(True)})

    def step(now, number):
        return now.select("id", F.when(F.col("n") < F.col("id"), F.col("n") + 1).otherwise(F.col("n")).alias("n"), (F.col("n") < F.col("id")).alias("moved"))

    done, passes = rounds.until_stable(start, step, lambda: F.col("moved"), 10)
    assert passes == 4 and all(r.n == r.id for r in done.collect())
    with pytest.raises(RuntimeError):
        rounds.until_stable(start, step, lambda: F.col("moved"), 3)
    assert rounds.until_stable(start.limit(0), step, lambda: F.col("moved"), 0)[1] == 0


def plain_reverts(jobs, events, detections, first, movable):
    out = []
    for job, status in jobs:
        now, gone, outcome = status or first, [], "untouched"
        while now in movable:
            steps = [(ts, prior or first) for j, ts, prior, to, auto in events if j == job and auto and to == now]
            if not steps:
                break
            ts, prior = max(steps)
            causes = [(seen, d, ok) for d, j, seen, ok in detections if j == job and seen <= ts and d not in gone]
            if not causes:
                outcome = "no_detection"
                break
            _, d, ok = max(causes)
            outcome = "kept" if ok else "reverted"
            if ok:
                break
            gone.append(d)
            now = prior
        out.append((job, now, len(gone), outcome, gone))
    return sorted(out)


def test_reverted_against_plain(spark):
    r = random.Random(8)
    names = ["discovered", "applied", "phone_screen", "offer"]
    jobs = [(j, r.choice([*names, None])) for j in range(60)]
    events = [(r.randrange(60), r.randint(0, 20), r.choice([*names, None]), r.choice(names), r.random() < 0.8) for _ in range(500)]
    detections = [(d, r.randrange(60), r.randint(0, 20), r.random() < 0.3) for d in range(260)]
    got = rounds.reverted(
        spark.createDataFrame(jobs, "job_id int, status string"), spark.createDataFrame(events, "job_id int, ts int, from_status string, to_status string, auto boolean"),
        spark.createDataFrame(detections, "detection_id long, job_id int, ts int, valid boolean"),
    )
    want = plain_reverts(jobs, events, detections, "discovered", ("phone_screen", "applied"))
    assert sorted((x.job_id, x.status, x.n_reverted, x.outcome, x.dismissed) for x in got.collect()) == want
    assert {x[3] for x in want} == {"untouched", "kept", "reverted", "no_detection"} and max(x[2] for x in want) > 1


def test_resweep_reads_stale_rows_only(spark, tmp_path):
    folder = str(tmp_path / "titles")
    rows = spark.createDataFrame([(i, f"Dev {i} Apply now", None, [], "apply") for i in range(9)], "job_id int, title string, raw_title string, reasons array<string>, classification string")
    for version, some in ((0, "job_id < 3"), (1, "job_id between 3 and 5"), (3, "job_id > 5")):
        resweep.append(rows.where(some), folder, version)
    stale = resweep.stored(spark, folder, below=2)
    assert {f.split("version=")[1][0] for f in stale.inputFiles()} == {"0", "1"}
    assert resweep.resweep(spark, folder, 2, resweep.retitled) == 2
    once = sorted(map(str, resweep.stored(spark, folder).collect()))
    assert resweep.stored(spark, folder, below=2) is None and resweep.resweep(spark, folder, 2, resweep.retitled) == 0
    assert sorted(map(str, resweep.stored(spark, folder).collect())) == once and len(once) == 9
    got = {r.job_id: (r.version, r.title, r.raw_title, r.classification) for r in resweep.stored(spark, folder).collect()}
    assert got[0] == (2, "Dev 0", "Dev 0 Apply now", None) and got[8] == (3, "Dev 8 Apply now", None, "apply")
    # the next rules: what was swept before is swept again from where it lies now; a sweep that broke off leaves no _SUCCESS and counts for nothing
    import shutil

    resweep.resweep(spark, folder, 3, lambda x: x.withColumn("title", F.upper("title")))
    (tmp_path / "titles/version=3/origin=2/_SUCCESS").unlink()
    assert {r.job_id: r.title for r in resweep.stored(spark, folder).collect()}[0] == "Dev 0"
    resweep.resweep(spark, folder, 3, lambda x: x.withColumn("title", F.upper("title")))
    assert {r.job_id: r.title for r in resweep.stored(spark, folder).collect()}[0] == "DEV 0"
    assert resweep.vacuum(spark, folder) == 3 and resweep.stored(spark, folder).count() == 9
    shutil.rmtree(folder)


def test_retitled(spark):
    rows = [(1, None, None, ["other"], "apply"), (2, "Dev", None, ["title_invalid_shape", "other"], "apply"), (3, "Dev Apply now", "first", [], "apply"), (4, "Apply now", None, None, "apply"), (5, "Dev ", None, [], "apply")]
    got = {r.job_id: r for r in resweep.retitled(spark.createDataFrame(rows, "job_id int, title string, raw_title string, reasons array<string>, classification string")).collect()}
    assert got[1].title is None and got[1].reasons == ["other"] and got[1].classification == "apply"
    assert got[2].reasons == ["other"] and got[2].classification == "apply"
    assert (got[3].title, got[3].raw_title, got[3].classification) == ("Dev", "first", None)
    assert got[4].title == "Apply now"
    assert (got[5].title, got[5].raw_title, got[5].classification) == ("Dev", "Dev ", "apply")  # only a space went, the score stays


def test_rekeyed(spark):
    rows = [(1, "old", "k", 0, 5, 5, "discovered", "apply"), (2, "k", "k", 2, 3, 9, "applied", "apply"), (3, "z", "z", 2, 1, 1, "reviewing", "apply"), (4, "q", "n", None, 1, 1, "reviewing", "apply"), (5, "z", "w", 3, 1, 1, "x", None)]
    table = spark.createDataFrame(rows, "job_id int, key string, new string, version int, first_seen int, last_seen int, status string, classification string")
    out, gone = resweep.rekeyed(table, 2, F.col("new"))
    got = {r.job_id: (r.key, r.version, r.last_seen, r.status, r.classification) for r in out.collect()}
    assert got == {2: ("k", 2, 9, "applied", None), 3: ("z", 2, 1, "reviewing", "apply"), 4: ("n", 2, 1, "reviewing", "apply"), 5: ("z", 3, 1, "x", None)}
    assert [tuple(r) for r in gone.collect()] == [(1, 2)]
    again, none = resweep.rekeyed(out, 2, F.col("new"))
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect())) and none.count() == 0


def test_draws_are_poisson_and_stable():
    hashes = np.arange(4000, dtype=np.int64) * 7919
    n = evals.draws(hashes, 50, 42)
    assert (n == evals.draws(hashes, 50, 42)).all() and (n[:7] == evals.draws(hashes[:7], 50, 42)).all() and not (n == evals.draws(hashes, 50, 43)).all()
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02 and abs(np.corrcoef(n[:, 0], n[:, 1])[0, 1]) < 0.06


def test_bca_against_numpy(spark):
    r = np.random.default_rng(3)
    groups = {"a": r.exponential(5, 80), "b": r.normal(0, 1, 300), None: r.lognormal(0, 1, 40), "one": np.array([4.0]), "same": np.full(9, 2.5)}
    rows = [(i, g, float(x)) for i, (g, x) in enumerate((g, x) for g, v in groups.items() for x in v)] + [(10**6, "a", None)]
    table = spark.createDataFrame(rows, "id long, g string, x double").repartition(5)
    got = {x.g: x for x in evals.bca_mean(table, "id", "x", "g", resamples=2000).collect()}
    assert set(got) == set(groups)
    hashes = {x.id: x.h for x in table.select("id", F.xxhash64("id").alias("h")).collect()}
    for g in ("a", "b", None):
        own = [(i, x) for i, k, x in rows if k == g and x is not None]
        x = np.array([v for _, v in own])
        n = evals.draws(np.array([hashes[i] for i, _ in own]), 2000, 42)
        means = (x @ n) / n.sum(axis=0)
        leave = np.array([np.delete(x, i).mean() for i in range(len(x))])  # leave-one-out means, one by one
        d = leave.mean() - leave
        acceleration = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        low, high = evals.bca_ends(means, x.mean(), acceleration)
        assert got[g].n == len(x) and np.allclose([got[g].mean, got[g].low, got[g].high], [x.mean(), low, high])
        assert low < x.mean() < high
        # and near what drawing with replacement gives
        drawn = r.choice(x, (4000, len(x))).mean(axis=1)
        assert np.allclose([low, high], evals.bca_ends(drawn, x.mean(), acceleration), atol=0.35 * (high - low))
    assert (got["one"].low, got["one"].high) == (None, None) and (got["same"].low, got["same"].high) == (2.5, 2.5)


def test_names_are_used_once():
    registry = Registry()

    def q_one(spark, sf_dir):
        return None

    registry.add("SELECT 1")(q_one)
    with pytest.raises(ValueError):
        registry.add()(q_one)
    with pytest.raises(ValueError):
        whole({"a": 1}, {"a": 2})


def test_reverts_look_at_few_detections(spark, monkeypatch):
    """Of fifty detections only the newest that is valid, and those after it, can count; none before is carried into the passes."""
    sizes = {}
    keep = rounds.written
    monkeypatch.setattr(rounds, "written", lambda df, name="state": (out := keep(df, name), sizes.setdefault(name, out.count()))[0])
    jobs = spark.createDataFrame([(1, "applied"), (2, "discovered")], "job_id int, status string")
    events = spark.createDataFrame([(1, 100, "discovered", "applied", True)], "job_id int, ts int, from_status string, to_status string, auto boolean")
    detections = spark.createDataFrame([(i, 1, i, i % 10 == 0) for i in range(1, 50)] + [(99, 1, 101, True), (98, 2, 5, False)], "detection_id long, job_id int, ts int, valid boolean")
    got = {r.job_id: tuple(r)[1:] for r in rounds.reverted(jobs, events, detections).collect()}
    assert got == {1: ("discovered", 1, "reverted", [49]), 2: ("discovered", 0, "untouched", [])}
    assert sizes["detections"] == 10 and sizes["newest"] == 1
    assert rounds.reverted(jobs, events, detections, movable=()).where("n_reverted > 0").isEmpty()
