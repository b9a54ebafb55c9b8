"""An import works each sheet out once, merges without adding rows up, and runs small steps side by side."""

import threading

import pytest
from test_import_disk import customers

from finlake.operators import incremental as INC
from finlake.operators import store as S
from finlake.operators import targets as T
from finlake.operators.store import Change, Store
from finlake.session import at_once

AS_OF = "1998-07-01"


def table(store, name="customers"):
    return sorted((str(r.company_id), r.code, r.segment) for r in store.read(name).collect())


def test_later_uploads_of_many_rows_are_read_once(spark, tmp_path):
    sc = spark.sparkContext
    reads = sc.accumulator(0)

    def read(row):
        reads.add(1)
        return row

    store, rows = Store(spark, str(tmp_path), parts=2), [("a", i, str(i % 250), f"n{i}", "x") for i in range(300)]
    for number in (1, 2):
        df = spark.createDataFrame(sc.parallelize(rows, 2).map(read), "company_id string, row_number long, customer_id string, customer_name string, segment string")
        assert T.import_batch(store, str(number), [T.Sheet("customers", df, "c.csv", most=len(rows))], AS_OF)
        assert reads.value == number * len(rows)
    assert len(table(store)) == 250


def test_merges_of_single_rows_add_nothing_up(spark, tmp_path, monkeypatch):
    store, plans = Store(spark, str(tmp_path), parts=2), []
    rows = [("a", 1, "1", "one", "x"), (None, 2, "1", "none", "x"), ("a", 3, "2", "two", "x"), ("b", 4, "3", "three", "x")]
    T.import_batch(store, "1", [customers(spark, rows)], AS_OF)
    write = Store._write
    monkeypatch.setattr(Store, "_write", lambda self, rows, name, version: plans.append((name, rows._jdf.queryExecution().optimizedPlan().toString())) or write(self, rows, name, version))
    T.import_batch(store, "2", [customers(spark, [("a", 1, "1", "one", "y"), (None, 2, "1", "none", "y"), (None, 3, "4", "four", "y"), ("b", 4, "3", "three", "x")])], AS_OF)
    (plan,) = [p for name, p in plans if name == "customers"]
    assert "Aggregate" not in plan and "LeftAnti" in plan, plan
    assert table(store) == [("None", "1", "y"), ("None", "4", "y"), ("a", "1", "y"), ("a", "2", "x"), ("b", "3", "x")]


@pytest.mark.parametrize("single", [False, True])
def test_an_upsert_replaces_stored_rows_whatever_its_keys(spark, tmp_path, single):
    store = Store(spark, str(tmp_path), parts=2)
    rows = lambda *r: spark.createDataFrame(r, "id string, sub string, n long, at long")
    store.commit("1", {"t": Change(rows(("k", None, 1, 5), (None, None, 2, 1), ("l", "x", 3, 1)), ["id", "sub"], order="at", single=single)})
    twice = [] if single else [("k", None, 9, 0)]
    store.commit("2", {"t": Change(rows(("k", None, 4, 1), *twice, (None, None, 5, None), ("m", "x", 6, 1)), ["id", "sub"], order="at", single=single)})
    got = sorted(map(str, ((r.id, r.sub, r.n) for r in store.read("t").collect())))
    assert got == sorted(map(str, [("k", None, 4), (None, None, 5), ("l", "x", 3), ("m", "x", 6)]))


def test_the_newest_row_of_a_key(spark):
    batch = [("d", "k", "h1", 1), ("d", "k", "h2", 2), ("d", "k", "h2", 3), ("d", "l", "h9", 4), ("d", "m", "h1", 5), ("d", "m", "h2", 6)]
    df = spark.createDataFrame(batch, "document_type string, business_key string, row_hash string, seq long")
    state = spark.createDataFrame([("d", "l", "h9", 3, "r")], "document_type string, business_key string, row_hash string, record_version int, record_id string")
    got = [(r.seq, r.record_version, r.newest) for r in INC.fingerprint_versions(df, state, newest="newest").orderBy("seq").collect()]
    assert got == [(1, 1, False), (2, 2, True), (3, 2, False), (4, 3, False), (5, 1, False), (6, 2, True)]


def test_small_types_of_a_table_are_versioned_side_by_side(spark, tmp_path, monkeypatch):
    """Types that share a table are versioned in threads of their own where they are known to be small, and bring the same."""
    got, threads = [], []
    versioned = T._versioned
    monkeypatch.setattr(T, "_versioned", lambda *a, **k: threads.append(threading.get_ident()) or versioned(*a, **k))
    for known in (0, 5):
        store = Store(spark, f"{tmp_path}/{known}", parts=2)
        for number, amount in ((1, "5"), (2, "7")):
            rows = spark.createDataFrame([("a", 1, "one", amount), (None, 2, "two", "1"), ("a", 3, " ", "2")], "company_id string, row_number long, name string, amount string")
            assert T.import_batch(store, str(number), [T.Sheet(t, rows, f"{t}.csv", most=known) for t in ("assets", "liabilities")], AS_OF)
        got.append([sorted(map(str, store.read(t).collect())) for t in ("assets_liabilities", T.HISTORY, T.REJECTS)])
    assert set(threads[:4]) == {threading.get_ident()} and threading.get_ident() not in threads[4:]
    assert got[0] == got[1] and all(got[0])
    assert T._no_more_than_a_slice(["a", "b"], {"a": 1, "b": S.SLICE_ROWS - 1})
    assert not T._no_more_than_a_slice(["a", "b"], {"a": 1, "b": S.SLICE_ROWS}) and not T._no_more_than_a_slice(["a", "b"], {"a": 1, "b": None})


def test_steps_side_by_side_all_end(spark):
    met, ended = threading.Barrier(2, timeout=30), []

    def step(n):
        met.wait()
        ended.append(n)
        if n == 1:
            raise ValueError("one")
        return spark.range(n).count()

    with pytest.raises(ValueError):
        at_once(spark, [lambda: step(1), lambda: step(2)])
    assert sorted(ended) == [1, 2]
    assert at_once(spark, [lambda: spark.range(3).count()]) == [3] and at_once(spark, []) == []


def test_a_purge_works_its_versions_out_once(spark, tmp_path, monkeypatch):
    store, lots = Store(spark, str(tmp_path), parts=2), []
    T.import_batch(store, "1", [customers(spark, [("a", 1, "1", "one", "x"), ("b", 1, "1", "uno", "x")])], AS_OF)
    files = spark.createDataFrame([("a", "customers.csv")], "company_id string, source_file string")
    scratch = Store.scratch
    monkeypatch.setattr(Store, "scratch", lambda self, slices, name: lots.append(name) or scratch(self, slices, name))
    assert T.source_purge(store, "2", files) and not T.source_purge(store, "2", files)
    assert lots == ["purge"] and table(store) == [("b", "1", "x")]
    assert [(r.company_id, r.business_key) for r in store.read(T.HISTORY).collect()] == [("b", "1")]
