from datetime import date, datetime, timedelta

import pytest

from marketweave.config import BarConfig, CoreConfig, read_flat_yaml
from marketweave.errors import DataSourceError, PermanentError, SchemaMismatchError, TransientError
from marketweave.operators import ingest
from marketweave.schemas import ALL, OHLCV, RecordSchema
from marketweave.sources import bars, universe

TODAY = date(2024, 6, 10)


# --- schemas, errors, settings ----------------------------------------------


def test_error_hierarchy():
    assert issubclass(TransientError, DataSourceError) and issubclass(PermanentError, DataSourceError)
    assert issubclass(SchemaMismatchError, PermanentError) and not issubclass(TransientError, PermanentError)


def test_declared_order_and_aliases(spark):
    assert OHLCV.columns() == ["date", "symbol", "Adj Close", "Close", "Dividends", "High", "Low", "Open", "Stock Splits", "Volume"]
    row = spark.createDataFrame([(1.0, "x", 2.0)], "adj_close double, other string, volume double")
    assert OHLCV.rename_attributes(row).columns == ["Adj Close", "other", "Volume"]


def test_validation_projects_or_raises(spark):
    df = spark.createDataFrame([("A", 1, 2.0)], "symbol string, extra int, `Adj Close` double")
    toy = RecordSchema("Toy", "toy", type(OHLCV.fields)([OHLCV.fields["symbol"], OHLCV.fields["Adj Close"]]), ("symbol",))
    assert toy.validate(df).columns == ["symbol", "Adj Close"]
    with pytest.raises(SchemaMismatchError, match=r"\['Adj Close', 'symbol'\]"):
        toy.validate(df.select("extra"))


def test_keys_are_columns_and_records_are_frozen():
    assert all(set(s.natural_key) <= set(s.columns()) for s in ALL)
    with pytest.raises(SchemaMismatchError):
        RecordSchema("Bad", "bad", OHLCV.fields, ("nope",))
    with pytest.raises(AttributeError):
        OHLCV.table = "x"
    request = ingest.FetchRequest(("A",), TODAY, TODAY)
    assert request.interval == "1d"
    with pytest.raises(AttributeError):
        request.end = TODAY


def test_settings_precedence(tmp_path):
    yaml, env = tmp_path / "c.yaml", tmp_path / ".env"
    yaml.write_text('# c\ninterval: "1d"\nbatch_size: 50 # small\ntable: "t"\nhistory_floor: "2010-02-03"\n')
    env.write_text("YAHOO_BATCH_SIZE=60\nYAHOO_SLEEP_SECONDS=3\n")
    load = lambda **k: BarConfig.load(yaml=yaml, dotenv=env, **k)
    assert read_flat_yaml(yaml)["batch_size"] == "50"
    assert load(env={}).batch_size == 60 and load(env={"YAHOO_BATCH_SIZE": "70"}).batch_size == 70
    assert load(env={"yahoo_batch_size": "70"}, batch_size=80).batch_size == 80
    assert load(env={}).sleep_seconds == 3 and load(env={}).history_floor == date(2010, 2, 3)
    assert BarConfig.load(env={}) == BarConfig("1d", 100, 10.0, date(2000, 1, 1), "ohlcv_1d")
    now = datetime(2024, 6, 10, 1)
    assert BarConfig.load("minute", env={}, now=now).history_floor == date(2024, 6, 3)
    with pytest.raises(PermanentError):
        BarConfig.load("weekly")
    assert CoreConfig.load(env={"SEC_USER_AGENT": "a b@c.d"}, dotenv=None).sec_user_agent == "a b@c.d"


# --- planning and the pipeline ----------------------------------------------


class Source:
    schema = OHLCV

    def __init__(self, spark, empty=()):
        self.spark, self.requests, self.empty = spark, [], set(empty)

    def fetch(self, request):
        self.requests.append(request)
        kept = [s for s in request.symbols if s not in self.empty]
        if kept:
            yield self.spark.createDataFrame([(request.start, s, *[0.0] * 8) for s in kept], OHLCV.fields)


def pipeline(spark, marks=None, empty=(), sink=None):
    source, state, sink, naps = Source(spark, empty), ingest.MemoryState(spark, marks), sink or ingest.ListSink(), []
    return ingest.BarPipeline(spark, source, state, sink, BarConfig.load(env={}), naps.append), source, state, sink, naps


def test_first_run_starts_at_the_floor(spark):
    p, source, state, sink, naps = pipeline(spark)
    assert p.run(["A", "B"], TODAY) == 2
    assert [(r.symbols, r.start, r.end) for r in source.requests] == [(("A", "B"), date(2000, 1, 1), TODAY)]
    assert state.marks == {"A": date(2000, 1, 1), "B": date(2000, 1, 1)} and naps == [10.0]
    frame, table, key = sink.frames[0]
    assert table == "ohlcv_1d" and key == ("date", "symbol") and frame.columns[-2:] == ["run_date", "inserted_at"]


def test_gaps_and_groups(spark):
    marks = {"A": TODAY, "B": TODAY - timedelta(days=1), "C": TODAY - timedelta(days=2), "D": TODAY - timedelta(days=5), "E": TODAY - timedelta(days=5), "Z": TODAY - timedelta(days=50)}
    p, source, *_ = pipeline(spark, marks)
    assert p.run(["E", "A", "B", "C", "D", "N"], TODAY) == 4
    assert [(r.symbols, r.start) for r in source.requests] == [(("E", "D"), TODAY - timedelta(days=4)), (("C",), TODAY - timedelta(days=1)), (("N",), date(2000, 1, 1))]


def test_nothing_to_do_and_empty_answers(spark):
    p, source, _, sink, naps = pipeline(spark, {"A": TODAY})
    assert p.run(["A"], TODAY) == 0 and not source.requests and not naps
    p, source, state, sink, naps = pipeline(spark, empty=["A"])
    assert p.run(["A"], TODAY) == 0 and not sink.frames and not naps and state.marks == {} and p.run([], TODAY) == 0


def test_failed_write_leaves_the_watermark(spark):
    class Broken(ingest.ListSink):
        def write(self, *a, **k):
            raise PermanentError("full")

    p, _, state, _, naps = pipeline(spark, sink=Broken())
    with pytest.raises(PermanentError):
        p.run(["A"], TODAY)
    assert state.marks == {} and not naps


def test_plan_keeps_repeats_and_ignores_unknown(spark):
    u = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A")], "pos int, symbol string")
    marks = spark.createDataFrame([("A", TODAY), ("X", TODAY)], "symbol string, max_date date")
    out = ingest.gap_plan(u, marks, date(2000, 1, 1), TODAY + timedelta(days=3))
    assert sorted((r.symbol, r.start) for r in out.collect()) == [("A", TODAY + timedelta(days=1))] * 2 + [("B", date(2000, 1, 1))]
    assert [list(r.symbols) for r in ingest.gap_groups(out).orderBy("start").collect()] == [["B"], ["A", "A"]]


def test_chunks(spark):
    u = spark.createDataFrame([(k, f"S{k}") for k in range(5)], "pos int, symbol string")
    assert [r.chunk_id for r in ingest.symbol_chunks(u, 2).orderBy("pos").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        ingest.symbol_chunks(u, 0)


def test_retry_only_transient():
    calls, naps = [], []

    def flaky(error, good_at):
        calls.append(1)
        if len(calls) < good_at:
            raise error("x")
        return "ok"

    assert ingest.retrying(lambda: flaky(TransientError, 3), sleep=naps.append) == "ok" and naps == [1.0, 2.0]
    calls.clear()
    with pytest.raises(PermanentError):
        ingest.retrying(lambda: flaky(PermanentError, 3), sleep=naps.append)
    assert len(calls) == 1


# --- state and sinks --------------------------------------------------------


def test_landing_state(spark, tmp_path):
    path = str(tmp_path / "t")
    assert ingest.LandingState(spark, None).get_watermarks("s").count() == 0
    state = ingest.LandingState(spark, path)
    assert state.get_watermarks("s").count() == 0
    spark.createDataFrame([("2024-01-02", "A"), ("2024-01-05", "A"), ("2024-01-03", "B")], "date string, symbol string").write.parquet(path)
    state.set_watermark("s", "A", TODAY)
    assert {r.symbol: r.max_date for r in state.get_watermarks("s").collect()} == {"A": date(2024, 1, 5), "B": date(2024, 1, 3)}


def test_append_and_insert_ignore(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "symbol string, n int")
    plain, careful = ingest.TableSink(str(tmp_path / "p")), ingest.TableSink(str(tmp_path / "i"), "insert_ignore")
    assert [plain.write(df, table="t", natural_key=["symbol"]) for _ in range(2)] == [3, 3]
    assert [careful.write(df, table="t", natural_key=["symbol"]) for _ in range(2)] == [2, 0]
    assert sorted(map(tuple, spark.read.parquet(careful.path("t")).collect())) == [("A", 1), ("B", 2)]
    for bad in (ingest.TableSink(None), ingest.JdbcSink(None)):
        with pytest.raises(PermanentError):
            bad.write(df, table="t", natural_key=["symbol"])


def test_relational_write_ignores_keys_that_are_there(spark):
    sink = ingest.JdbcSink("jdbc:derby:memory:marketweave;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    make = lambda *rows: spark.createDataFrame(list(rows), "symbol string, date date, price double")
    first, again = make(("A", TODAY, 1.5), ("B", TODAY, 2.5)), make(("A", TODAY, 9.0), ("A", TODAY + timedelta(days=1), 3.5), ("C", TODAY, 4.5), ("C", TODAY, 4.5))
    key = ["symbol", "date"]
    assert [sink.write(df, table="bars", natural_key=key) for df in (first, first, again, again, first.limit(0))] == [2, 0, 2, 0, 0]
    stored = sorted((r.symbol, r.price) for r in bars.read_jdbc(spark, sink.url, "bars", sink.properties).collect())
    assert stored == [("A", 1.5), ("A", 3.5), ("B", 2.5), ("C", 4.5)]
    left = bars.read_jdbc(spark, sink.url, "SYS.SYSTABLES", sink.properties).where("TABLENAME like '%STAGING%'")
    assert left.count() == 0


def test_prune_keeps_recent_and_unloaded(spark):
    now = datetime(2024, 6, 1)
    rows = spark.createDataFrame([(1, now - timedelta(days=90)), (2, now - timedelta(days=90)), (3, now - timedelta(days=5))], "id int, _ingested_at timestamp")
    assert sorted(r.id for r in ingest.prune(rows, rows.where("id <> 2"), ["id"], now).collect()) == [2, 3]
    with pytest.raises(PermanentError):
        ingest.prune(rows, rows, ["id"], now, keep_days=7)


def test_incremental_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 2, 1))], "id int, _ingested_at timestamp").write.parquet(path)
    out = ingest.incremental(spark.read.parquet(path), datetime(2024, 1, 15))
    assert [r.id for r in out.collect()] == [2] and ingest.incremental(out, None) is out
    assert "GreaterThan(_ingested_at" in out._jdf.queryExecution().executedPlan().toString()


# --- sources ----------------------------------------------------------------


def test_vendor_source_chunks_and_skips_empty(spark):
    def client(symbols, start, end, interval):
        return [(start, s, *[1.0] * 8) for s in symbols if s != "E"]

    source = bars.VendorBarSource(spark, client, BarConfig.load(env={}, batch_size=2))
    request = ingest.FetchRequest(("A", "B", "C", "E", "E"), date(2020, 1, 1), date(2020, 1, 10))
    assert source.scan(request).rdd.getNumPartitions() == 3
    got = []
    for f in source.fetch(request):
        assert f.columns == OHLCV.columns()
        got.append(sorted(r.symbol for r in f.collect()))
    assert got == [["A", "B"], ["C"]]


def test_vendor_source_retries(spark, tmp_path):
    flag = str(tmp_path / "flag")

    def client(symbols, start, end, interval):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise TransientError("later")
        return [(start, s, *[1.0] * 8) for s in symbols]

    source = bars.VendorBarSource(spark, client, BarConfig.load(env={}))
    assert source.scan(ingest.FetchRequest(("A",), TODAY, TODAY)).count() == 1


def test_stored_source_pushes_the_window(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.createDataFrame([(TODAY + timedelta(days=k), s, *[1.0] * 8) for k in range(4) for s in "AB"], OHLCV.fields).write.parquet(path)
    source = bars.StoredBarSource(spark, path, BarConfig.load(env={}))
    request = ingest.FetchRequest(("A", "Z"), TODAY, TODAY + timedelta(days=2))
    (frame,) = source.fetch(request)
    assert frame.count() == 2
    assert "PushedFilters: [" in (plan := frame._jdf.queryExecution().executedPlan().toString()) and "LessThan(date" in plan and "In(symbol" in plan
    assert bars.read_symbol(spark, path, "B").count() == 4


PAGE = "<p><table><tr><th>Symbol</th><th>Name</th></tr><tr><td><a>BRK.B</a></td><td>x<table><tr><td>in</td></tr></table></td></tr><tr><td> MMM\n</td><td>y</td></tr></table><table><tr><td>no</td></tr></table>"


def test_universes(spark):
    doc = '{"0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple"}, "1": {"cik_str": 1, "ticker": "X", "title": "Y"}}'
    seen = []

    def get(url, agent, timeout):
        seen.append((url, agent, timeout))
        return doc if url.endswith("json") else PAGE

    assert sorted(map(tuple, universe.fetch_tickers(spark, "a b@c.d", get=get).collect())) == [("AAPL", "0000320193", "Apple"), ("X", "0000000001", "Y")]
    assert [r.symbol for r in universe.fetch_constituents(spark, "a b@c.d", get=get).orderBy("pos").collect()] == ["BRK.B", "MMM"]
    assert [s[2] for s in seen] == [100, 100]
    for fetch in (universe.fetch_tickers, universe.fetch_constituents):
        for agent in (None, ""):
            with pytest.raises(PermanentError):
                fetch(spark, agent, get=get)
    with pytest.raises(PermanentError):
        universe.first_table_column("<p>no table</p>")
