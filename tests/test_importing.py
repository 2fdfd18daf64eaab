"""Import rules, counters, files and atomic publishing."""

import json


import pytest
from helpers import plant_with_tags, utc, workbook_bytes
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import importing
from millrace.operators.importing import ImportMapping, WideColumn
from millrace.operators.transactions import FolderImport
from millrace.sources import tabular, workbook
from millrace.sources.tables import SCHEMAS
from millrace import session
from millrace.streaming.arrivals import Arrivals

LONG = ImportMapping(
    timestamp_column="time", tag_code_column="tag", value_column="value",
    device_code_column="device", quality_column="quality",
)
FLOAT_TAG = [(1, "TEMP", "float", 0.0, 100.0)]


def raw_rows(spark, rows, batch=1):
    columns = "batch_id LONG, plant_id LONG, source_row LONG, time STRING, device STRING, tag STRING, value STRING, quality STRING"
    data = [(batch, 1, n, *row) for n, row in enumerate(rows, start=2)]
    return spark.createDataFrame(data, columns)


def run(spark, rows, tables, mapping=LONG, limit=10_000):
    classified = importing.classify(
        raw_rows(spark, rows), mapping, tables, importing.existing_keys(tables.tag_sample)
    )
    found = importing.issues(classified, mapping)
    counts = importing.counters(classified, found, limit).first().asDict()
    return classified, found, counts


def test_mixed_rows_are_counted_by_first_broken_rule(spark):
    rows = [
        ("2026-08-22T10:00:00+08:00", "d1", " temp ", "25", "Good"),
        ("2026-08-22T10:01:00+08:00", "D1", "TEMP", "26", "BadSensorFailure"),
        ("2026-08-22T10:02:00+08:00", "D1", "TEMP", "2000", "Good"),
        ("2026-08-22T10:03:00+08:00", "D1", "OTHER", "1", "Good"),
        ("2026-08-22T02:00:00Z", "D1", "TEMP", "27", "Good"),
    ]
    classified, found, counts = run(spark, rows, plant_with_tags(spark, FLOAT_TAG))
    assert counts == {
        "batch_id": 1, "total_rows": 5, "accepted_rows": 2, "rejected_rows": 3, "duplicate_rows": 1,
        "warning_rows": 1, "issue_count": 4, "stored_issue_count": 4, "issues_truncated": False,
    }
    rules = [r.rule for r in classified.orderBy("source_row").collect()]
    assert rules == [None, None, "out_of_range", "unknown_pair", "duplicate_in_file"]
    first = classified.where("source_row = 2").select(F.unix_micros("source_timestamp")).first()[0]
    assert first == utc(2026, 8, 22, 2).timestamp() * 1e6
    message = found.where("issue_type = 'out_of_range'").first().message
    assert message == "数值超出测点范围 [0.0, 100.0]"


def test_a_bad_time_is_one_issue_but_rejects_every_measurement(spark):
    mapping = ImportMapping(
        timestamp_column="time", layout="wide", quality_column="quality",
        wide_columns=(WideColumn("value", "TEMP"), WideColumn("tag", "PRESS", "D1")),
    )
    tables = plant_with_tags(spark, [*FLOAT_TAG, (2, "PRESS", "float", None, None)])
    rows = [
        ("2026-08-22T10:00:00", None, "1.5", "20", "Bad"),
        ("never", None, "1.6", "21", "Bad"),
        ("", None, "1.7", "22", "Good"),
        ("2026-08-22T10:01:00", None, "", "23", ""),
    ]
    classified, found, counts = run(spark, rows, tables, mapping)
    assert (counts["total_rows"], counts["accepted_rows"], counts["rejected_rows"]) == (8, 3, 5)
    assert (counts["warning_rows"], counts["issue_count"]) == (1, 4)
    kinds = sorted(r.issue_type for r in found.collect())
    assert kinds == ["bad_quality", "invalid_timestamp", "missing_required", "missing_required"]
    pressure = classified.where("tag_id = 2 AND rule IS NULL").select("numeric_value").first()[0]
    assert pressure == 1.5


def test_a_wide_mapping_meets_its_own_codes_only(spark):
    mapping = ImportMapping(
        timestamp_column="time", layout="wide",
        wide_columns=(WideColumn("value", " temp"), WideColumn("tag", "PRESS", "d1"), WideColumn("quality", "PRESS", "D2")),
    )
    tables = plant_with_tags(spark, [(n, f"X{n}", "float", None, None) for n in range(3, 50)] + [
        (1, "TEMP", "float", None, None), (2, "PRESS", "float", None, None)
    ])
    raw = raw_rows(spark, [("2026-01-01T00:00:00Z", "1", None, "2", "3")])
    found = importing.resolve_tags(importing.source_measurements(raw, mapping), tables, mapping)
    # Joined by a broadcast that the plan knows from the start: the measurements are not shuffled to a few codes.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    rows = {r.value_field: (r["_matches"], r["_tag"] and r["_tag"].tag_id) for r in found.collect()}
    assert rows == {"value": (1, 1), "tag": (1, 2), "quality": (0, None)}


def test_existing_file_rows_block_and_live_rows_do_not(spark):
    at = utc(2026, 8, 22, 2)
    row = (None, None, None, None, 1, "5", 5.0, at, None, at, "Good", True)
    live, filed = list(row), list(row)
    live[:4], filed[:4] = [1, 9, None, "opcua"], [2, None, 7, "file"]
    again = [("2026-08-22T10:00:00", "D1", "TEMP", "25", None)] * 2
    _, _, with_live = run(spark, again, plant_with_tags(spark, FLOAT_TAG, tag_sample=[tuple(live)]))
    assert (with_live["accepted_rows"], with_live["duplicate_rows"]) == (1, 1)
    classified, _, with_file = run(spark, again, plant_with_tags(spark, FLOAT_TAG, tag_sample=[tuple(filed)]))
    assert (with_file["accepted_rows"], with_file["duplicate_rows"]) == (0, 2)
    assert [r.rule for r in classified.orderBy("source_row").collect()] == ["duplicate_existing", "duplicate_in_file"]


def test_same_code_twice_is_ambiguous_without_a_device(spark):
    tables = plant_with_tags(spark, [*FLOAT_TAG, (2, "Temp", "float", None, None)])
    classified, _, _ = run(spark, [("2026-08-22T10:00:00", "", "TEMP", "1", None)], tables)
    assert classified.first().issue_type == "ambiguous_tag"


def test_one_key_with_a_third_of_all_rows(spark):
    """A repeated key keeps its first row only, wherever its rows lie."""
    same = [("2026-08-22T10:00:00", "D1", "TEMP", str(n % 90), None) for n in range(400)]
    other = [(f"2026-08-22T{h:02d}:{m:02d}:30", "D1", "TEMP", "1", None) for h in range(13) for m in range(60)]
    classified, _, counts = run(spark, other + same, plant_with_tags(spark, FLOAT_TAG))
    assert counts["accepted_rows"] == len(other) + 1
    assert counts["duplicate_rows"] == len(same) - 1
    kept = classified.where("rule IS NULL AND source_row > " + str(len(other) + 1)).collect()
    assert [r.source_row for r in kept] == [len(other) + 2]


def test_issue_cap_counts_everything(spark):
    rows = [("bad", "D1", "TEMP", "1", None)] * 30
    classified, found, counts = run(spark, rows, plant_with_tags(spark, FLOAT_TAG), limit=10)
    assert (counts["issue_count"], counts["stored_issue_count"], counts["issues_truncated"]) == (30, 10, True)
    kept = importing.stored_issues(found, 10)
    assert sorted(r.row_number for r in kept.collect()) == list(range(2, 12))
    report = importing.issue_report(kept)
    assert report.columns[1:] == ["行号", "严重级别", "问题类型", "字段", "原始值", "说明"]


def test_all_issues_are_stored_without_a_limit(spark, monkeypatch):
    monkeypatch.setattr(importing, "ISSUE_CHUNK_ROWS", 7)
    classified = importing.classify(
        raw_rows(spark, [("bad", "D1", "TEMP", "1", None)] * 60), LONG, tables := plant_with_tags(spark, FLOAT_TAG),
        importing.existing_keys(tables.tag_sample),
    )
    found = importing.issues(classified, LONG)
    counts = importing.counters(classified, found).first()
    assert (counts["issue_count"], counts["stored_issue_count"], counts["issues_truncated"]) == (60, 60, False)
    stored, limited = importing.stored_issues(found), importing.stored_issues(found, 1000)
    assert stored.schema.names == limited.schema.names
    assert sorted(map(str, stored.collect())) == sorted(map(str, limited.collect())) and stored.count() == 60


@pytest.mark.parametrize(
    "bad",
    [
        {"timestamp_column": "t"},
        {"timestamp_column": "t", "layout": "wide"},
        {"timestamp_column": "t", "layout": "wide", "value_column": "v", "wide_columns": (WideColumn("a", "A"),)},
        {"timestamp_column": "t", "layout": "wide", "wide_columns": (WideColumn("a", "A"), WideColumn("a", "B"))},
        {"timestamp_column": "t", "tag_code_column": "c", "value_column": "v", "wide_columns": (WideColumn("a", "A"),)},
    ],
)
def test_invalid_mappings(bad):
    with pytest.raises(ValueError):
        ImportMapping(**bad)


def test_missing_columns_fail_the_import(spark):
    with pytest.raises(ValueError, match="value"):
        importing.source_measurements(raw_rows(spark, []).drop("value"), LONG)


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


def test_csv_profiles(spark, tmp_path):
    paths = [
        write(tmp_path / "a.csv", "﻿时间;测点;数值\r\n2026-08-22;T;1\r\n"),
        write(tmp_path / "b.csv", "时间\t测点\t数值\n2026-08-22\tT\t1\n", "gb18030"),
        write(tmp_path / "c.csv", "value\n1\n"),
        write(tmp_path / "d.csv", 'a,b\n"x\ny",1\n'),
        write(tmp_path / "e.csv", "a,a\n1,2\n"),
        write(tmp_path / "f.csv", "a,\n1,2\n"),
    ]
    (tmp_path / "g.csv").write_bytes(b"\xff\xff\xff")
    found = {r.path.rsplit("/", 1)[1]: r for r in tabular.profile(spark, [*paths, str(tmp_path / "g.csv")]).collect()}
    assert (found["a.csv"].encoding, found["a.csv"].delimiter, found["a.csv"].header[0]) == ("utf-8-sig", ";", "时间")
    assert (found["b.csv"].encoding, found["b.csv"].delimiter) == ("gb18030", "\t")
    assert (found["c.csv"].delimiter, found["d.csv"].multi_line) == (",", True)
    assert [bool(found[n].error) for n in ("e.csv", "f.csv", "g.csv")] == [True] * 3


def test_csv_rows_and_numbers(spark, tmp_path):
    path = write(tmp_path / "rows.csv", 'a,b\n1,2\n\n3\n4,5,6\n"x\ny",7\n')
    rows = tabular.read_files(spark, [path]).orderBy("source_row").collect()
    assert [(r.source_row, r.a, r.b) for r in rows] == [
        (2, "1", "2"), (3, "3", None), (4, "4", "5"), (5, "x\ny", "7"),
    ]
    german = write(tmp_path / "gb.csv", "时间,值\n一,二\n", "gb18030")
    assert [tuple(r)[1:3] for r in tabular.read_files(spark, [german]).select("path", "时间", "值").collect()] == [("一", "二")]


def test_row_numbers_survive_file_splits(spark, tmp_path):
    path = write(tmp_path / "long.csv", "n,text\n" + "".join(f"{n},row number {n}\n" for n in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = tabular.read_files(spark, [path])
        assert rows.rdd.getNumPartitions() > 1
        assert rows.where("source_row <> n + 2").count() == 0
        assert rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


ROWS_XML = (
    '<row r="1"><c r="A1" t="inlineStr"><is><t> time </t></is></c><c r="B1" t="inlineStr"><is><t>value</t></is></c></row>'
    '<row r="2"><c r="A2" s="1"><v>46256.5</v></c><c r="B2"><v>7</v></c></row>'
    '<row r="4"><c r="A4" t="str"><v>2026-08-22</v></c><c r="B4" t="b"><v>1</v></c></row>'
)


def test_workbooks(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    path.write_bytes(workbook_bytes(ROWS_XML))
    preview = tabular.inspect(spark, str(path))
    assert (preview.columns, preview.sheet, preview.encoding) == (["time", "value"], "data", None)
    rows = [(r.source_row, r.time, r.value) for r in preview.rows.collect()]
    assert rows == [(2, "2026-08-22T12:00:00", "7"), (3, None, None), (4, "2026-08-22", "True")]
    with pytest.raises(workbook.WorkbookError):
        list(workbook.sheet_rows(b"not a workbook"))
    (tmp_path / "empty.xlsx").write_bytes(workbook_bytes(""))
    assert tabular.profile(spark, [str(tmp_path / "empty.xlsx")]).first().error


def test_header_only_and_suffix(spark, tmp_path):
    path = write(tmp_path / "head.csv", "timestamp,tag_code,value\n")
    with pytest.raises(tabular.TabularError, match="no data rows"):
        tabular.inspect(spark, path)
    with pytest.raises(tabular.TabularError):
        tabular.file_format("notes.txt")


def test_fingerprints(spark, tmp_path):
    first, second = write(tmp_path / "1.csv", "a\n1\n"), write(tmp_path / "2.csv", "a\n1\n")
    rows = tabular.fingerprints(spark, [first, second]).collect()
    assert len({r.file_sha256 for r in rows}) == 1
    assert {r.file_size_bytes for r in rows} == {4}


def test_process_publishes_whole_batches(spark, tmp_path):
    tables = plant_with_tags(spark, FLOAT_TAG)
    target = str(tmp_path / "samples")
    rows = [(f"2026-08-22T10:00:{s:02d}", "D1", "TEMP", "5", None) for s in range(5)]
    result = importing.process(spark, raw_rows(spark, rows), LONG, tables, target)
    assert result.samples.count() == 5

    def stored():
        return tables.replaced(tag_sample=spark.read.parquet(target).withColumn("id", F.lit(0)))

    repeat = importing.process(spark, raw_rows(spark, rows), LONG, stored(), target)
    assert repeat.samples.count() == 5
    assert repeat.counters.first().accepted_rows == 5
    other = importing.process(spark, raw_rows(spark, rows, batch=2), LONG, stored(), target)
    assert other.counters.first().duplicate_rows == 5


def test_failed_import_publishes_nothing(spark, tmp_path):
    target = tmp_path / "samples"
    boom = F.udf(lambda s: 1 / 0, "string")
    broken = raw_rows(spark, [("2026-08-22T10:00:00", "D1", "TEMP", "5", None)]).withColumn("value", boom("value"))
    with pytest.raises(PySparkException):
        importing.process(spark, broken, LONG, plant_with_tags(spark, FLOAT_TAG), str(target))
    assert not target.exists()


def test_arriving_files_are_imported_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    lines = "".join(f"2026-08-22T10:00:{s:02d},D1,TEMP,{s},Good\n" for s in range(10))
    write(inbox / "one.csv", "time,device,tag,value,quality\n" + lines)
    write(inbox / "copy.csv", "time,device,tag,value,quality\n" + lines)
    watch = Arrivals(spark, str(inbox), str(tmp_path / "root"), LONG, plant_with_tags(spark, FLOAT_TAG), 1)
    watch.start().awaitTermination()
    assert sorted(r.status for r in watch.ledger().collect()) == ["duplicate", "imported"]
    assert spark.read.parquet(watch.samples_path).count() == 10
    more = "".join(f"2026-08-22T10:00:{s:02d},D1,TEMP,{s},Good\n" for s in range(5, 20))
    write(inbox / "two.csv", "time,device,tag,value,quality\n" + more)
    write(inbox / "again.csv", "time,device,tag,value,quality\n" + lines)
    watch.start().awaitTermination()
    assert sorted(r.status for r in watch.ledger().collect()) == ["duplicate", "duplicate", "imported", "imported"]
    assert spark.read.parquet(watch.samples_path).count() == 20
    totals = watch.counters().agg(F.sum("accepted_rows"), F.sum("duplicate_rows")).first()
    assert tuple(totals) == (20, 5)


def test_one_unreadable_file_fails_alone(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    write(inbox / "good.csv", "time,device,tag,value,quality\n2026-08-22T10:00:00,D1,TEMP,1,Good\n")
    (inbox / "bad.csv").write_bytes(b"time,device,tag,value,quality\n" + b"\xff" * 9 + b"\n")
    write(inbox / "empty.csv", "\n")
    watch = Arrivals(spark, str(inbox), str(tmp_path / "root"), LONG, plant_with_tags(spark, FLOAT_TAG), 1)
    watch.start().awaitTermination()
    noted = {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in watch.ledger().collect()}
    assert noted["good.csv"] == ("imported", None)
    assert noted["bad.csv"] == ("failed", "CSV files must be UTF-8 or GB18030") and noted["empty.csv"][0] == "failed"
    assert spark.read.parquet(watch.samples_path).count() == 1


@pytest.mark.parametrize("shift", range(3))
def test_encoding_is_judged_by_all_bytes(shift):
    head = "x" * shift + "a,b\n"
    assert tabular.detect_encoding((head + "温度" * 200_000).encode()) == "utf-8-sig"
    late = (head + "plain\n" * 200_000).encode() + "温度".encode("gb18030")
    assert tabular.detect_encoding(late) == "gb18030"
    with pytest.raises(tabular.TabularError):
        tabular.detect_encoding((head + "plain\n" * 200_000).encode() + b"\xff\xff\xff")


def test_scratch_folder_is_never_local_on_a_cluster():
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Cluster())


def test_schemas_parse(spark):
    for ddl in SCHEMAS.values():
        assert spark.createDataFrame([], ddl).columns


def _folder_import(spark, tmp_path, files, tables):
    folder = tmp_path / "inbox"
    folder.mkdir()
    for name, raw in files.items():
        (folder / name).write_bytes(raw if isinstance(raw, bytes) else raw.encode())
    store = FolderImport(spark, str(tmp_path / "store"))
    mapping = ImportMapping(timestamp_column="time", tag_code_column="tag", value_column="value")
    rows = store.run(1, str(folder), mapping, tables, F.lit(1).cast("long"), F.lit("2026-01-01").cast("timestamp"))
    return store, folder, mapping, {r.path.rsplit("/", 1)[1]: r for r in rows.collect()}


def test_each_file_is_a_transaction(spark, tmp_path):
    tables = plant_with_tags(spark, [(1, "A", "string", None, None)])
    good = "time,tag,value\n2026-01-01T00:00:00Z,A,{}\n"
    files = {
        "utf8.csv": "﻿" + good.format("x") + "   \n\n2026-01-02T00:00:00Z,A,y\n",
        "gb.csv": "time;tag;value;备注\n2026-01-03T00:00:00Z;A;压力;注\n2026-01-03T00:00:01Z;A;ok;\n".encode("gb18030"),
        "tab.csv": "time\ttag\tvalue\r\n\t\t\r\n2026-01-04T00:00:00Z\tA\tz\r\n",
        "quoted.csv": 'time,tag,value\n2026-01-05T00:00:00Z,A,"two\nlines"\n2026-01-05T00:00:01Z,A,"a,""b"""\n',
        "lacks.csv": "time,tag,reading\n2026-01-06T00:00:00Z,A,1\n", "lacks-but-empty.csv": "time,tag\n",
        "broken.csv": b"time,tag,value\n\x81\x30\n", "twice.csv": "time,tag,time\n1,2,3\n", "empty.csv": "\n",
    }
    store, folder, mapping, rows = _folder_import(spark, tmp_path, files, tables)
    state = {n: (r.status, r.error_message, r.total_rows, r.accepted_rows, r.published_rows) for n, r in rows.items()}
    assert state == {
        "utf8.csv": ("completed", None, 3, 2, 2), "gb.csv": ("completed", None, 2, 2, 2), "tab.csv": ("completed", None, 2, 1, 1),
        "quoted.csv": ("completed", None, 2, 2, 2), "lacks.csv": ("failed", "映射列不存在：value", 0, 0, 0),
        "lacks-but-empty.csv": ("completed", None, 0, 0, 0), "broken.csv": ("failed", "CSV files must be UTF-8 or GB18030", 0, 0, 0),
        "twice.csv": ("failed", "source column headers must be unique", 0, 0, 0), "empty.csv": ("failed", "the file has no header row", 0, 0, 0),
    }
    values = sorted(json.loads(r.value) for r in store.samples().collect())
    assert values == sorted(["x", "y", "压力", "ok", "z", "two\nlines", 'a,"b"'])
    # Lines of blanks are rows with a number of their own; empty lines are not.
    cells, _ = tabular.line_cells(spark, str(folder), tabular.profiles_in(spark, str(folder)))
    found = sorted((r.path.rsplit("/", 1)[1], r.source_row, r.cells[:3]) for r in cells.where("path LIKE '%utf8%' OR path LIKE '%tab%'").collect())
    assert [(n, k) for n, k, _ in found] == [("tab.csv", 2), ("tab.csv", 3), ("utf8.csv", 2), ("utf8.csv", 3), ("utf8.csv", 4)]
    assert found[3][2][0] == "   "
    # A second run of the same files replaces its batches and adds nothing.
    store.run(2, str(folder), mapping, tables, F.lit(1).cast("long"), F.lit("2026-01-01").cast("timestamp"))
    assert store.samples().count() == 7 and store.batches().count() == 9 and store.batches().where("run = 2").count() == 9


def test_samples_without_a_batch_row_are_not_seen(spark, tmp_path):
    tables = plant_with_tags(spark, [(1, "A", "float", None, None)])
    store, *_ = _folder_import(spark, tmp_path, {"a.csv": "time,tag,value\n2026-01-01T00:00:00Z,A,1\n"}, tables)
    stray = store.samples().drop("sample_date").withColumn("import_run", F.lit(7).cast("long"))
    store.table.add(store.table.placed(stray), 7)
    assert store.table.rows().count() == 2 and store.samples().count() == 1


def test_one_wrong_date_does_not_open_the_table(spark, tmp_path):
    """Known keys are looked up in the candidates' own days, whatever lies between them."""
    tables = plant_with_tags(spark, [(1, "A", "float", None, None)])
    days = "".join(f"2026-01-{d:02}T00:00:00Z,A,{d}\n" for d in range(1, 29))
    store, folder, mapping, rows = _folder_import(spark, tmp_path, {"all.csv": "time,tag,value\n" + days}, tables)
    assert rows["all.csv"].accepted_rows == 28
    other = tmp_path / "later"
    other.mkdir()
    (other / "b.csv").write_text("time,tag,value\n1900-01-01T00:00:00Z,A,1\n2026-01-09T00:00:00Z,A,9\n2999-01-01T00:00:00Z,A,1\n")
    found = store.run(2, str(other), mapping, tables, F.lit(1).cast("long"), F.lit("2026-01-01").cast("timestamp")).first()
    assert (found.accepted_rows, found.duplicate_rows, found.published_rows) == (2, 1, 2)
    keys = [("1900-01-01 00:00:00", 1), ("2026-01-09 00:00:00", 1), ("2999-01-01 00:00:00", 1)]
    asked = spark.createDataFrame(keys, "t string, tag_id long").selectExpr("tag_id", "cast(t as timestamp) as source_timestamp")
    known = store.known_keys(asked)
    read = {f.split("sample_date=")[1][:10] for f in known.inputFiles() if "sample_date=" in f}
    assert read == {"1900-01-01", "2026-01-09", "2999-01-01"} and known.count() == 3
