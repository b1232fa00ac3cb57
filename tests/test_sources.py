import gzip
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from txnlens.functions.schema import RAW_COLUMNS
from txnlens.operators.splits import content_identity, data_identity
from txnlens.plans import inputs, tables
from txnlens.sources import events, id_filters, ops
from txnlens.sources.ledger import MissingColumns, load_bronze, number_rows, read_ledger, to_bronze, write_ledger
from txnlens.sources import grown_files
from txnlens.streaming import scored_ingest
from txnlens.streaming.scored_ingest import ingest_scored_events, stream_scored_events

SF = "/root/testdata/sf0.001"
HEADER = ",".join(RAW_COLUMNS)


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_missing_columns_are_named(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["step,type,amount", "1,PAYMENT,5"])
    with pytest.raises(MissingColumns, match="nameOrig.*isFlaggedFraud"):
        read_ledger(spark, path)


def test_bad_lines(spark, tmp_path):
    good = "1,PAYMENT,5.0,C1,10,5,M1,0,0,0,0"
    path = write(tmp_path / "a.csv", [HEADER, good, good.replace("5.0", "oops"), good])
    assert len(read_ledger(spark, path, mode="DROPMALFORMED").collect()) == 2
    kept = read_ledger(spark, path, mode="PERMISSIVE").collect()
    assert len(kept) == 3 and sum(r["_corrupt_record"] is not None for r in kept) == 1
    with pytest.raises(Exception):
        read_ledger(spark, path).collect()


def test_rows_are_numbered_in_source_order_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_ledger(inputs.ledger(spark, SF), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = read_ledger(spark, path)
        assert raw.rdd.getNumPartitions() > 5
        got = sorted((r.row_num, r.step, r.amount) for r in to_bronze(raw, "x").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted((r.row_num, r.step, r.amount) for r in inputs.ledger(spark, SF).collect())
    assert got == want


def test_limit_keeps_the_first_rows(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_ledger(inputs.ledger(spark, SF), path)
    assert read_ledger(spark, path, limit=7).count() == 7


def test_load_bronze_is_a_full_refresh(spark, tmp_path):
    path, out = str(tmp_path / "csv"), str(tmp_path / "bronze")
    write_ledger(inputs.ledger(spark, SF), path)
    assert [load_bronze(spark, path, out) for _ in range(2)] == [1000, 1000]
    assert spark.read.parquet(out).count() == 1000


def test_hour_folders_and_success_marker(spark, tmp_path):
    path = tmp_path / "ev"
    events.write_scored_events(tables.scored_events(spark, SF), str(path))
    assert (path / "_SUCCESS").exists()
    folders = {p.parent.name + "/" + p.name for p in path.glob("dt=*/hr=*")}
    assert "dt=2024-01-01/hr=00" in folders
    back = events.read_scored_events(spark, str(path))
    assert back.count() == 1000 and back.where("features.txn_type IS NULL").count() == 0
    newest = events.recent_events(spark, str(path), 5, 3).collect()
    assert len(newest) == 3 and [r.scored_at_us for r in newest] == sorted((r.scored_at_us for r in newest), reverse=True)


def test_ingest_remembers_files_and_first_write_wins(spark, tmp_path):
    src, ckpt, out = tmp_path / "src", str(tmp_path / "ckpt"), str(tmp_path / "out")
    hour = src / "dt=2024-01-01" / "hr=00"
    hour.mkdir(parents=True)
    line = '{{"event_id":"{i}","fraud_score":{s},"scored_at_us":{t},"unknown":1}}'
    (hour / "a.jsonl").write_text("\n".join([line.format(i="x", s=0.1, t=1), "{broken", '{"fraud_score":0.5}', line.format(i="y", s=0.2, t=1), ""]))
    stream_scored_events(spark, str(src), ckpt, out).awaitTermination()
    (hour / "b.jsonl").write_text("\n".join([line.format(i="x", s=0.9, t=0), line.format(i="z", s=0.3, t=5), line.format(i="z", s=0.4, t=6)]) + "\n")
    for _ in range(2):
        stream_scored_events(spark, str(src), ckpt, out).awaitTermination()
    assert {r.event_id: r.fraud_score for r in spark.read.parquet(out).collect()} == {"x": 0.1, "y": 0.2, "z": 0.3}


def test_growing_files_arrive_once(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    hours = [src / "dt=2024-01-01" / f"hr={h}" for h in ("00", "01")]
    line = '{{"event_id":"{i}","fraud_score":{s},"scored_at_us":1}}\n'
    second = line.format(i="e2", s=0.2)
    for hour in hours:
        hour.mkdir(parents=True)
    grown = hours[0] / "a.jsonl"
    grown.write_text(line.format(i="e1", s=0.1) + second[:20])
    (hours[1] / "a.jsonl").write_text(line.format(i="e4", s=0.4))

    def found():
        return sorted((r.event_id, r.fraud_score) for r in spark.read.parquet(out).collect())

    assert ingest_scored_events(spark, str(src), out) == 2
    assert found() == [("e1", 0.1), ("e4", 0.4)]
    with grown.open("a") as f:
        f.write(second[20:] + line.format(i="e3", s=0.3) + line.format(i="e1", s=0.9))
    assert events.close_hours(spark, str(src), before=("2024-01-01", "01")) == 1
    assert (hours[0] / "_SUCCESS").exists() and not (hours[1] / "_SUCCESS").exists()
    assert ingest_scored_events(spark, str(src), out) == 3  # the cut line and the two after it, not what was read before
    assert found() == [("e1", 0.1), ("e2", 0.2), ("e3", 0.3), ("e4", 0.4)]
    assert ingest_scored_events(spark, str(src), out) == 0
    with (hours[1] / "b.jsonl").open("w") as f:
        f.write(line.format(i="e5", s=0.5)[:-1])  # complete once its hour is closed
    assert ingest_scored_events(spark, str(src), out) == 0
    assert events.close_hours(spark, str(src)) == 1
    assert [ingest_scored_events(spark, str(src), out) for _ in range(2)] == [1, 0]
    assert len(found()) == 5


def test_a_load_that_fails_is_repeated(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "src", str(tmp_path / "out")
    hour = src / "dt=2024-01-01" / "hr=00"
    hour.mkdir(parents=True)
    line = '{{"event_id":"{i}","fraud_score":0.5,"scored_at_us":1}}\n'
    (hour / "a.jsonl").write_text(line.format(i="e1"))
    monkeypatch.setattr(scored_ingest, "filters_of", lambda ids: 1 / 0)  # after the events, before the batch is done
    with pytest.raises(Exception):
        ingest_scored_events(spark, str(src), out)
    monkeypatch.undo()
    with (hour / "a.jsonl").open("a") as f:
        f.write(line.format(i="e2"))
    assert ingest_scored_events(spark, str(src), out) == 2
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["e1", "e2"]


@pytest.mark.parametrize("size, block", [(1, 1), (7, 3), (64, 5), (1000, 1 << 20)])
def test_ranges_hold_every_line_once(tmp_path, monkeypatch, size, block):
    monkeypatch.setattr(grown_files, "RANGE", size)
    monkeypatch.setattr(grown_files, "BLOCK", block)
    hour = tmp_path / "dt=1" / "hr=2"
    hour.mkdir(parents=True)
    data = b"".join(b"%d:" % k + b"x" * (k * 7 % 23) + b"\n" for k in range(40)) + b"\n\nlast"
    (hour / "a").write_bytes(b"")
    reader, at, got, taken = grown_files.GrownLinesReader(str(tmp_path)), reader_start(tmp_path), [], 0
    for cut in (5, 6, 100, 101, 300, len(data) - 4, len(data)):
        (hour / "a").write_bytes(data[:cut])
        if cut == len(data):
            (hour / "_SUCCESS").touch()
        end = reader.latestOffset()
        parts = reader.partitions(at, end)
        taken += sum(p.end - p.begin for p in parts)
        got += [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert reader.partitions(end, reader.latestOffset()) == []
        at = end
    assert got == data.decode().split("\n") and taken == len(data)
    assert at == {"through": "dt=1/hr=2", "files": {}}


def reader_start(path):
    return grown_files.GrownLinesReader(str(path)).initialOffset()


def test_loads_open_only_batches_that_may_hold_their_ids(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    for k in range(4):
        hour = src / "dt=2024-01-01" / f"hr=0{k}"
        hour.mkdir(parents=True)
        ids = [f"e{k}-{i}" for i in range(300)] + ([f"e1-{i}" for i in range(5)] if k == 3 else [])
        (hour / "a.jsonl").write_text("".join(f'{{"event_id":"{i}","fraud_score":{k / 10},"scored_at_us":{k}}}\n' for i in ids))
        assert ingest_scored_events(spark, str(src), out) == len(ids)
    assert spark.read.parquet(out).groupBy("batch_id").count().orderBy("batch_id").collect() == [(k, 300) for k in range(4)]
    new = spark.createDataFrame([("e1-7",), ("e3-8",), ("other",)], "event_id string")
    assert scored_ingest.batches_to_open(spark, out, new, 4) == [1, 3]
    assert scored_ingest.batches_to_open(spark, out, new, 3) == [1]
    assert scored_ingest.batches_to_open(spark, out, new.where("event_id = 'other'"), 4) == []
    (tmp_path / "out_ids" / "batch_id=2" / "_SUCCESS").unlink()  # without its filter a batch is opened
    assert scored_ingest.batches_to_open(spark, out, new, 4) == [1, 2, 3]


def test_staging_has_no_labels(spark, tmp_path):
    path = str(tmp_path / "staging")
    events.export_staging(inputs.silver(spark, SF), path)
    assert not {"is_fraud", "is_flagged_fraud", "bronze_row_num"} & set(spark.read.json(path).columns)
    with pytest.raises(Exception):
        events.export_staging(inputs.silver(spark, SF), path)


def test_cache_is_keyed_by_data(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for print_id in ("a", "a", "b"):
        assert events.cached(spark, str(tmp_path), "k", print_id, build).count() == 3
    assert len(built) == 2


def test_runs_are_recorded_and_failures_raised(spark, tmp_path):
    table = str(tmp_path / "runs")
    with ops.track_run(spark, table, "ok") as run:
        ops.move_counted(spark.range(12), str(tmp_path / "moved"), lambda rows: rows.where("id % 12 < 5"), run)
    with pytest.raises(KeyError):
        with ops.track_run(spark, table, "bad"):
            raise KeyError("x")
    got = {r.layer: (r.status, r.rows_in, r.rows_out) for r in spark.read.parquet(table).collect()}
    assert got == {"ok": ("success", 12, 5), "bad": ("failed", None, None)}


def test_labels(spark):
    labels = spark.createDataFrame([("a", True), ("b", False)], "event_id string, is_fraud boolean")
    edits = spark.createDataFrame([("a", None), ("b", True), ("c", False)], "event_id string, is_fraud boolean")
    assert {r.event_id: r.is_fraud for r in ops.apply_label_edits(labels, edits).collect()} == {"b": True, "c": False}
    text = spark.createDataFrame([("a", " TRUE"), ("b", "False"), ("c", "fraud"), ("d", "1.0")], "event_id string, is_fraud string")
    known = spark.createDataFrame([("a",), ("b",)], "event_id string")
    got = {r.event_id: (r.is_fraud, r.known) for r in ops.parse_label_csv(text, known).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (True, False), "d": (False, False)}


def test_data_identity_ignores_order(spark):
    df = inputs.scored(spark, SF).select("row_num", "step", "y")
    assert data_identity(df).first() == data_identity(df.repartition(7).orderBy("y")).first()
    assert data_identity(df.where("row_num > 1")).first().fingerprint != data_identity(df).first().fingerprint


def test_bad_lines_do_not_depend_on_what_is_read(spark, tmp_path):
    names = list(RAW_COLUMNS)
    good = "1,PAYMENT,1.0,C1,1.0,0.0,M1,0.0,0.0,0,0"
    for part in range(3):
        lines = [",".join(names), good, good.replace("1.0", "bad", 1), good, good.replace("0,0", "x,0"), good]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    df = read_ledger(spark, str(tmp_path), mode="DROPMALFORMED")
    rows = df.collect()
    assert df.count() == len(rows) == df.select(names[0]).count() == len(df.select(names[3]).collect())
    numbered = number_rows(df)
    assert sorted(r["row_num"] for r in numbered.collect()) == list(range(1, len(rows) + 1))
    assert read_ledger(spark, str(tmp_path), limit=4, mode="DROPMALFORMED").count() == 4


def test_last_edit_of_an_event_counts(spark):
    labels = spark.createDataFrame([("a", True), ("b", True)], "event_id string, is_fraud boolean")
    edits = spark.createDataFrame([("a", False, 1), ("a", None, 2), ("b", None, 1), ("b", False, 2), ("c", True, 1), ("c", True, 1)],
                                  "event_id string, is_fraud boolean, at int")
    got = ops.apply_label_edits(labels, edits, order="at").collect()
    assert sorted(map(tuple, got)) == [("b", False), ("c", True)]


def test_cache_follows_content_and_ignores_unfinished_writes(spark, tmp_path):
    one, two = (spark.createDataFrame([(1, x), (2, x)], "row_num int, amount double") for x in (1.0, 2.0))
    assert content_identity(one) != content_identity(two)
    assert content_identity(one) == content_identity(one.orderBy(F.desc("row_num")))
    assert content_identity(one) != content_identity(one.unionByName(one).unionByName(one))
    (tmp_path / "k-x").mkdir()
    for frame in (one, two):  # the second finds the first one's copy
        assert events.cached(spark, str(tmp_path), "k", "x", lambda f=frame: f).agg(F.sum("amount")).first()[0] == 2.0


def test_logged_events_are_packed_and_load_once(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    rows = spark.range(400).selectExpr("concat('e', id) AS event_id", "id * 60000000 AS scored_at_us", "0.5D AS fraud_score")
    events.write_scored_events(rows.where("scored_at_us % 120000000 = 0"), str(src))
    files = list(src.glob("dt=*/hr=*/part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert ingest_scored_events(spark, str(src), out) == 200
    events.write_scored_events(rows, str(src))
    assert ingest_scored_events(spark, str(src), out) == 400
    events.close_hours(spark, str(src))
    assert ingest_scored_events(spark, str(src), out) == 0
    back = spark.read.parquet(out)
    assert back.count() == back.select("event_id").distinct().count() == 400


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_packed_files_grow_by_members(tmp_path, monkeypatch, block):
    monkeypatch.setattr(grown_files, "BLOCK", block)
    hour = tmp_path / "dt=1" / "hr=2"
    hour.mkdir(parents=True)
    first, second = (b"".join(b"%d:%d\n" % (m, k) * 9 for k in range(50)) for m in (1, 2))
    reader, at, got = grown_files.GrownLinesReader(str(tmp_path)), reader_start(tmp_path), []
    for members in ([first], [first, second + b"last"], [first, second + b"last"]):
        (hour / "a.gz").write_bytes(b"".join(map(gzip.compress, members)))
        end = reader.latestOffset()
        for part in reader.partitions(at, end):
            got += [x for b in reader.read(part) for x in b.column(0).to_pylist()]
        at = end
    assert got == (first + second).decode().splitlines() + ["last"]
    (hour / "b.gz").write_bytes(gzip.compress(first)[:-9])
    with pytest.raises(ValueError, match="ends inside"):
        [list(reader.read(p)) for p in reader.partitions(at, reader.latestOffset())]


def test_small_files_share_tasks_and_keep_their_lines(tmp_path):
    want = []
    for h in range(24):
        hour = tmp_path / "dt=1" / f"hr={h:02d}"
        hour.mkdir(parents=True)
        for k in range(9):
            lines = [f"{h}-{k}-{i}" for i in range(k)]
            text = "".join(f"{x}\n" for x in lines).encode()
            (hour / f"a{k}").write_bytes(text + b"open")
            (hour / f"b{k}.gz").write_bytes(gzip.compress(text))
            want += lines * 2
    reader = grown_files.GrownLinesReader(str(tmp_path), tasks=4)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(end["files"]) == 24 * 18 and 4 <= len(parts) <= 40  # a range each was a task each, 408 of them
    got = [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert sorted(got) == sorted(want)


def test_ranges_go_together_up_to_a_size(monkeypatch):
    def ranges(sizes):
        return [grown_files.ByteRange(f"a{k}", 0, n, n, True) for k, n in enumerate(sizes)]

    def held(parts):
        return [[p.file, *(m.file for m in p.more)] for p in parts]

    monkeypatch.setattr(grown_files, "OPENING", 1)
    monkeypatch.setattr(grown_files, "RANGE", 100)
    monkeypatch.setattr(grown_files, "BLOCK", 10)
    assert held(grown_files.dealt(ranges([100, 40, 40, 40, 100, 3]), 1)) == [["a0"], ["a1", "a2"], ["a3"], ["a4"], ["a5"]]
    assert held(grown_files.dealt(ranges([4] * 8), 4)) == [["a0", "a1"], ["a2", "a3"], ["a4", "a5"], ["a6", "a7"]]
    assert grown_files.dealt([], 4) == []
    packed = [grown_files.ByteRange(f"{k}.gz", 0, 6, 6, True) for k in range(4)]
    assert held(grown_files.dealt(packed, 1)) == [["0.gz", "1.gz"], ["2.gz", "3.gz"]]  # text of 48 bytes each


def test_lines_that_are_not_utf8_are_read(tmp_path):
    hour = tmp_path / "dt=1" / "hr=2"
    hour.mkdir(parents=True)
    (hour / "a").write_bytes(b"\n\xff\xfe,x\n\xc3\xa9\n\n")
    reader = grown_files.GrownLinesReader(str(tmp_path))
    [part] = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [x for b in reader.read(part) for x in b.column(0).to_pylist()] == ["", "��,x", "é", ""]


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"event_id":"a","fraud_score":0.5}',), ('{"fraud_score":1}',), ("{broken",), (None,), ("[]",)], "value string")
    found = events.parse_scored_events(lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [(r.event_id, r.fraud_score) for r in found.collect()] == [("a", 0.5)]


def test_junk_lines_of_an_hour_are_few_files(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tables, "ingest_scored_events", lambda spark, src, out: seen.append(src) or ingest_scored_events(spark, src, out))
    assert tables.ingest_scored_jsonl(spark, SF).count() == 1000
    read = spark.read.text(seen[0], pathGlobFilter="*.txt").selectExpr("dt", "hr", "_metadata.file_path AS f")
    assert read.groupBy("dt", "hr").agg(F.countDistinct("f").alias("n")).agg(F.sum("n") - F.count("n")).first()[0] < 8


def test_probing_makes_no_object_of_an_id():
    rng = np.random.default_rng(5)
    held, other = (rng.integers(-2**63, 2**63 - 1, (2, 20_000)) for _ in range(2))
    bits = id_filters._build(id_filters.pd.DataFrame({"h1": held[0], "h2": held[1], "bucket": 3}))["bits"][0]

    def asked(h):
        pairs = pa.StructArray.from_arrays([pa.array(h[0]), pa.array(h[1])], ["h1", "h2"])
        return pa.ListArray.from_arrays(pa.array([0, h.shape[1]], pa.int32()), pairs)

    def batch(ids):
        return pa.RecordBatch.from_arrays(
            [pa.array([7, 8, 9]), pa.array([bits] * 3), pa.concat_arrays([asked(x) for x in ids])], ["batch_id", "bits", "ids"])

    rows = batch([other, np.hstack([other, held[:, :1]]), held[:, :0]]).slice(1)
    tracemalloc.start()
    found = [x for b in id_filters._probe(iter([batch([other, held[:, -1:], held[:, :0]]), rows])) for x in b.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [8, 8]
    assert peak < 5 << 20  # 9.7 MB with an object of each id, 2.7 without


def test_a_struct_of_the_features_is_taken_whole(spark):
    rows = inputs.scored_with_features(spark, SF).where("step <= 100")
    other = rows.selectExpr("* EXCEPT (f)", "struct(f.* EXCEPT (amount), f.amount) AS f")
    whole, named = (events.to_scored_events(x) for x in (rows, other))
    plans = [df._jdf.queryExecution().analyzed().toString() for df in (whole, named)]
    assert [p.count("named_struct(is_first_txn, f#") for p in plans] == [0, 1]
    assert whole.schema == named.schema and sorted(map(str, whole.collect())) == sorted(map(str, named.collect()))
    gone = events.to_scored_events(rows.selectExpr("* EXCEPT (f)", "if(step < 0, f, NULL) AS f"))
    assert gone.where("features IS NULL").isEmpty() and not gone.isEmpty()
