"""Streams with state against the same asked of tables."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import history
from tessera.streaming import alerts

ROW = "supplier_id long, base string, thickness string, product_form string, id long, available_slabs long, day timestamp, material_type string, material_key string, image_url string"


def day(n):
    return dt.datetime(2024, 1, n)


def listing(sid, d, name, slabs, thickness="2cm", form="Slab", key=None):
    return (sid, name, thickness, form, key or abs(hash((sid, d, name, thickness, form))) % 10**9, slabs, day(d), "Slate", f"{name}|slate", None)


def land(spark, folder, n, listings=(), ends=()):
    """One file of the stream."""
    frame = alerts.crawled(spark.createDataFrame(list(listings), ROW), F.col("day"))
    marks = alerts.ended(spark.createDataFrame([(s, day(d), r) for s, d, r in ends], "supplier_id long, day timestamp, rebased int"))
    frame.unionByName(marks).coalesce(1).write.mode("append").parquet(f"{folder}/{n:03d}")
    return frame.schema


def run(spark, tmp_path, salts=3):
    schema = alerts.crawled(spark.createDataFrame([], ROW), F.col("day")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    alerts.follow(spark, stream, f"{tmp_path}/out", f"{tmp_path}/state", salts).awaitTermination()
    return sorted(map(tuple, alerts.digest(spark, f"{tmp_path}/out").collect()))


def table(spark, listings, rebased=()):
    """The digest of a table of listings."""
    rows = spark.createDataFrame(list(listings), ROW).dropDuplicates(["id"])
    past = history.snapshots(rows, F.col("day"))
    marked = F.lit(False)
    for s, d in rebased:
        marked = marked | ((F.col("supplier_id") == s) & (F.col("snapshot_date") == F.lit(day(d))))
    return sorted(map(tuple, history.digest(past.withColumn("rebased", marked.cast("int"))).collect()))


ONE = [listing(1, 1, "up", 0), listing(1, 1, "half", 20), listing(1, 1, "gone", 3), listing(1, 1, "moved", 4), listing(1, 1, "out", 5), listing(1, 1, "same", 2), listing(2, 1, "a", 9), listing(2, 1, "b", 9), listing(2, 1, "c", 9)]
TWO = [listing(1, 3, "up", 4), listing(1, 3, "half", 6), listing(1, 3, "half", 3, form="Remnant"), listing(1, 3, "moved", 4, "3cm"), listing(1, 3, "out", 0), listing(1, 3, "same", 2), listing(1, 3, "fresh", 1), listing(2, 3, "a", 9)]


def test_a_crawl_over_several_batches(spark, tmp_path):
    land(spark, tmp_path / "in", 0, ONE[:3] + ONE[6:7])
    land(spark, tmp_path / "in", 1, ONE[3:6], [(1, 1, 0)])
    assert run(spark, tmp_path) == []  # one crawl says nothing
    land(spark, tmp_path / "in", 2, ONE[7:] + TWO[:4], [(2, 1, 0)])
    assert run(spark, tmp_path) == []  # the second hasn't ended
    land(spark, tmp_path / "in", 3, TWO[4:], [(1, 3, 0), (2, 3, 0)])
    want = table(spark, ONE + TWO)
    assert run(spark, tmp_path) == want and {r[3] for r in want} == {"restock", "dropped", "delisted", "soldout", "listed"}
    assert not any(r[0] == 2 for r in want)  # a supplier whose listings fell by more than half


def test_late_and_repeated_batches(spark, tmp_path):
    land(spark, tmp_path / "in", 0, ONE, [(1, 1, 0), (2, 1, 0)])
    land(spark, tmp_path / "in", 1, TWO[:3], [(1, 3, 0), (2, 3, 0)])
    early = run(spark, tmp_path)
    assert early and early != table(spark, ONE + TWO)
    land(spark, tmp_path / "in", 2, TWO[3:])  # late, after the end of the crawl
    land(spark, tmp_path / "in", 3, TWO, [(1, 3, 0)])  # all of it again
    assert run(spark, tmp_path) == table(spark, ONE + TWO)
    # a crawl between the two that is told late takes the place of the first
    between = [listing(1, 2, "up", 7), listing(1, 2, "half", 9), listing(1, 2, "same", 12)]
    land(spark, tmp_path / "in", 4, between, [(1, 2, 0)])
    assert run(spark, tmp_path) == table(spark, ONE + between + TWO)
    # and one before both says nothing any more
    land(spark, tmp_path / "in", 5, [listing(1, 1, "never", 50)], [(1, 1, 0)])
    assert run(spark, tmp_path) == table(spark, ONE + between + TWO)


def test_counts_that_changed_and_one_key(spark, tmp_path):
    land(spark, tmp_path / "in", 0, ONE, [(1, 1, 0), (2, 1, 0)])
    land(spark, tmp_path / "in", 1, TWO, [(1, 3, 1), (2, 3, 0)])
    got = run(spark, tmp_path, salts=1)
    assert got == table(spark, ONE + TWO, [(1, 3)]) and not {"dropped", "soldout"} & {r[3] for r in got}


def test_long_ids_beside_an_end(spark, tmp_path):
    """Rows that come with an end and again later count once, also where ids go beyond what a float tells apart."""
    big = 2**60
    one = [listing(1, 1, f"n{i}", 1, key=big + i) for i in range(3)]
    two = [listing(1, 3, f"n{i}", 5, key=big + 10 + i) for i in range(3)] + [listing(1, 3, "n0", 2, "3cm", key=big + 13)]
    land(spark, tmp_path / "in", 0, one, [(1, 1, 0)])
    land(spark, tmp_path / "in", 1, two, [(1, 3, 0)])
    land(spark, tmp_path / "in", 2, two)
    late = [listing(1, 3, "n4", 7, key=big + 14)]
    land(spark, tmp_path / "in", 3, late)
    got = run(spark, tmp_path)
    assert got == table(spark, one + two + late) and {r[4] for r in got} == {2, 7}


def test_a_batch_that_is_run_again_replaces_what_it_wrote(spark, tmp_path):
    land(spark, tmp_path / "in", 0, ONE, [(1, 1, 0), (2, 1, 0)])
    land(spark, tmp_path / "in", 1, TWO, [(1, 3, 0), (2, 3, 0)])
    want = run(spark, tmp_path)
    # the last batch's commit is lost, so that the stream runs it again
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "state" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run(spark, tmp_path) == want == table(spark, ONE + TWO)


def test_shares_of_a_bucket_are_weighed_together():
    """What a batch brings for 300 shares costs a few calls of state, and each is told what plain dicts say of it."""
    import random

    import pandas as pd

    calls = []

    class Map(dict):
        iterator, removeKey = lambda self: iter([*self.items()]), dict.__delitem__  # noqa: N815

        def updateValue(self, key, value):  # noqa: N802
            calls.append(key)
            self[key] = value

    class Value(list):
        exists, get, update = lambda self: bool(self), lambda self: self[-1], lambda self, v: (calls.append(v), self.append(v))

    class Handle:
        getMapState, getValueState = lambda self, *_: Map(), lambda self, *_: Value()  # noqa: N815

    r, crawls = random.Random(5), alerts._Crawls()
    crawls.init(Handle())
    days = [pd.Timestamp("2024-01-01") + pd.Timedelta(i, "us") for i in range(5)]
    listings, ends, told, columns = {}, {}, set(), ["supplier_id", "salt", "day", "ends", "rebased", "id", "name_norm", "thickness", "slabs"]
    for n in range(8):
        came = [(2**60 + r.randrange(150), r.randrange(2), r.choice([*days, pd.NaT]), False, 0, 2**60 + r.randrange(9), r.choice(["a", "b", "c", None]), r.choice(["2cm", "", None]), r.randrange(4)) for _ in range(900)]
        came += [(2**60 + r.randrange(150), r.randrange(2), r.choice(days), True, r.randrange(2), 0, None, None, 0) for _ in range(90 * (n > 1))]
        got = {}
        calls.clear()
        for part in crawls.handleInputRows((0,), iter([pd.DataFrame(came[:400], columns=columns), pd.DataFrame(came[400:], columns=columns)]), None):
            for row in part.astype(object).where(part.notna(), None).itertuples(index=False):
                got.setdefault((row.supplier_id, row.salt), []).append(row)
        assert len(calls) <= len(days) + 1
        marks, seen = {}, {}
        for sid, salt, day, is_end, rebased, key, *rest in came:
            if day is not pd.NaT:
                seen.setdefault((sid, salt), set()).add(day)
                if is_end:
                    marks[sid, salt, day] = max(rebased, marks.get((sid, salt, day), 0))
                else:
                    listings.setdefault((sid, salt), {}).setdefault(day, {})[key] = rest
        for (sid, salt, day), rebased in marks.items():
            ends.setdefault((sid, salt), {})[day] = rebased
        want = {k for k in seen if seen[k] & set(sorted(ends.get(k, ()))[-2:]) and len(ends.get(k, ())) > 1}
        assert got.keys() == want
        for k in want:
            before, now = sorted(ends[k])[-2:]
            sums, was, is_ = {}, *(listings.get(k, {}).get(d, {}) for d in (before, now))
            for side, part in ((0, is_), (1, was)):
                for name, thickness, slabs in part.values():
                    if name is not None and thickness is not None:
                        at = sums.setdefault((name, thickness), [None, None])
                        at[side] = (at[side] or 0) + slabs
            names = [len({v[0] for v in part.values()} - {None}) for part in (is_, was)]
            fixed = (now, bool(ends[k][now]) and not ends[k][before], *names)
            assert {x[4:] for x in got[k]} == {(*p, *v, *fixed[1:]) for p, v in sums.items()} | {(None, None, None, None, *fixed[1:])}
            assert len(got[k]) == len(sums) + 1 and {x.latest_date for x in got[k]} == {now} and {x.seq for x in got[k]} == {n + 1}
            told.add(fixed[1])
    assert told == {True, False}


# --- run monitor --------------------------------------------------------------------------------

EVENT = "catalog string, run_id string, at timestamp, kind string, value string"


def at(minutes):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minutes)


def told(spark, tmp_path, batches, timeout=90):
    from tessera.streaming import monitor

    for i, rows in enumerate(batches):
        spark.createDataFrame([(c, r, at(m), k, v) for c, r, m, k, v in rows], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events/{i:03d}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events/*")
    monitor.follow(spark, stream, f"{tmp_path}/told", f"{tmp_path}/monitor", timeout).awaitTermination()
    return monitor.told(spark, f"{tmp_path}/told")


def by_table(spark, batches, now, timeout=90):
    """What the ledger and its states say of a table of the events up to now."""
    from tessera.operators import ledger

    out = set()
    for catalog in {r[0] for b in batches for r in b}:
        rows = [(r, at(m), k, f"{v}: x" if v else v) for b in batches for c, r, m, k, v in b if c == catalog and at(m) <= now]
        if rows:
            runs = ledger.ledger(spark.createDataFrame(rows, "run_id string, at timestamp, kind string, value string")).drop("detail")
            out |= {(catalog, r.run_id, r.state) for r in ledger.run_state(runs, F.lit(now), timeout).collect()}
    return out


def test_runs_that_fall_silent(spark, tmp_path):
    from tessera.streaming import monitor

    batches = [
        [("a", "r1", 0, "start", None), ("a", "r1", 10, "beat", None), ("b", "s1", 5, "start", None)],
        [("a", "r1", 60, "phase", "images"), ("b", "s1", 50, "finish", "done"), ("clock", "x", 70, "start", None)],
        [("clock", "x", 140, "beat", None)],
        [("clock", "x", 200, "beat", None)],  # nobody has said a word of r1: it is interrupted at 150
        [("a", "r1", 210, "beat", None), ("b", "s2", 205, "start", None)],  # it wasn't dead
        [("a", "r2", 220, "start", None), ("clock", "x", 230, "beat", None)],  # a later run makes it so
        [("a", "r2", 300, "finish", "failed"), ("b", "s2", 240, "beat", None), ("b", "s3", 290, "start", None)],
        [("clock", "x", 600, "beat", None)],
        [("clock", "x", 601, "finish", "done")],
    ]
    found = told(spark, tmp_path, batches).cache()
    for now in (3, 45, 65, 130, 151, 199, 212, 225, 241, 295, 350, 383, 599):
        got = {tuple(r) for r in monitor.states(found, F.lit(at(now))).collect()}
        assert got == by_table(spark, batches, at(now)), now
    rows = [(r.run_id, r.state) for r in found.where("catalog = 'a'").orderBy("at").collect()]
    assert rows == [("r1", "running"), ("r1", "interrupted"), ("r1", "running"), ("r1", "interrupted"), ("r2", "running"), ("r2", "failed")]


def test_finished_runs_are_forgotten_in_time(spark, tmp_path):
    from tessera.streaming import monitor

    batches = [[("a", f"r{i:02d}", 10 * i, "start", None), ("a", f"r{i:02d}", 10 * i + 5, "finish", "done")] for i in range(12)]
    found = told(spark, tmp_path, batches)
    got = {tuple(r) for r in monitor.states(found, F.lit(at(500))).collect()}
    assert got == by_table(spark, batches, at(500)) == {("a", f"r{i:02d}", "done") for i in range(12)}


def test_a_word_is_not_weighed_against_every_run(monkeypatch):
    """Of 3000 runs in a catalog, each silent before the next begins, a word meets its own and the one that falls silent."""
    import pandas as pd

    from tessera.streaming import monitor

    class Map(dict):
        containsKey, removeKey = dict.__contains__, dict.__delitem__  # noqa: N815
        getValue, updateValue, iterator = dict.__getitem__, dict.__setitem__, lambda self: iter(list(self.items()))  # noqa: N815

    class Value(list):
        exists, get, update = lambda self: bool(self), lambda self: self[-1], lambda self, v: self.append(v)

    class Handle:
        timers: set = set()
        getMapState, getValueState = lambda self, *_: Map(), lambda self, *_: Value()  # noqa: N815
        listTimers = lambda self: list(self.timers)  # noqa: N815
        registerTimer, deleteTimer = lambda self, t: self.timers.add(t), lambda self, t: self.timers.discard(t)  # noqa: N815

    weighed = []
    runs = monitor._Runs(90)
    runs.init(Handle())
    tell = getattr(runs, "_tell", None) or (lambda *_: None)
    monkeypatch.setattr(runs, "_tell", lambda *a: weighed.append(1) or tell(*a), raising=False)
    n = 3000
    words = pd.DataFrame({"run_id": [f"r{i:04d}" for i in range(n)], "at": [pd.Timestamp(at(100 * i)) for i in range(n)], "kind": "start", "value": None})
    (told_,) = runs.handleInputRows(("a",), iter([words]), None)
    assert list(told_["state"].value_counts().sort_index().items()) == [("interrupted", n - 1), ("running", n)]
    assert n <= len(weighed) <= 2 * n and len(Handle.timers) == 1


def test_batches_land_in_more_than_one_task(spark, monkeypatch):
    """A stream's batch isn't drawn together into one task before it lands."""
    from pyspark.sql.classic.dataframe import DataFrame

    from tessera.upkeep_queries import QUERIES

    def refuse(*_):
        raise AssertionError("one task for a whole batch")

    monkeypatch.setattr(DataFrame, "coalesce", refuse)
    assert QUERIES["r1_streamed_snapshots"](spark, "/root/testdata/sf0.001").count() > 0
