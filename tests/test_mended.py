"""Inputs that once came out wrong: files of one name, JSON as written, sessions, samples, digests and times."""

import gzip

import pytest
from pyspark.sql import functions as F

from quarry.functions import json_text as J
from quarry.functions import text as T
from quarry.operators import evaluation as G
from quarry.operators import store as S
from quarry.sources import files as IO


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, rows in (("x", 'h,k\n1,"a\nb"\n4,,\n'), ("y y+%", "h\n5,6,7,8\n\n9\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.csv").write_text(rows)
        (tmp_path / folder / "t.txt").write_text(folder)
        with gzip.open(tmp_path / folder / "l.jsonl.gz", "wt") as f:
            f.write('{"a":1}\n' if folder == "x" else '{"a":\n{}\n')
    csv = IO.read_csv_rows(spark, str(tmp_path / "*" / "a.csv"))
    got = sorted((r.source_file.rsplit("/", 2)[-2], r.pos, r.cells, r.header) for r in csv.collect())
    assert got == [("x", 1, ["1", "a\nb"], ["h", "k"]), ("x", 2, ["4", "", ""], ["h", "k"]), ("y y+%", 1, ["5", "6", "7", "8"], ["h"]), ("y y+%", 2, ["9"], ["h"])]
    for folder in ("x", "y y+%"):
        (tmp_path / folder / "a.csv").unlink()
    names = {r.source_file for r in IO.read_text_documents(spark, str(tmp_path)).where("source_file like '%.txt'").collect()}
    assert names == {"x/t.txt", "y y+%/t.txt"}
    for folder in ("x", "y y+%"):
        (tmp_path / folder / "t.txt").unlink()
    assert [tuple(r) for r in IO.jsonl_quality(IO.read_jsonl_records(spark, str(tmp_path))).collect()] == [("y y+%/l.jsonl.gz", 1, "invalid JSON")]
    one = IO.read_jsonl_records(spark, str(tmp_path / "x" / "l.jsonl.gz")).first()
    assert (one.source_file, one.line) == ("l.jsonl.gz", 1)


@pytest.mark.parametrize(
    "text,records,reason",
    [
        ('[{"v":1.50,"k":1e3},{}]', [(1, '{"v":1.50,"k":1e3}')], None),
        ("[]", [], None),
        (' \n[ {"a" : 1} , [2 , 3] ] ', [(1, '{"a" : 1}'), (2, "[2 , 3]")], None),
        ("[1, 2]", [(1, "[1, 2]")], None),
        ('"x"', [(1, '"x"')], None),
        ('{"a":1},{"b":2}', [], "invalid JSON"),
        ('[{"a":NaN}]', [], "not a number"),
        ("[" * 100_000, [], "invalid JSON"),
        (None, [], None),
    ],
)
def test_records_are_kept_as_written(spark, text, records, reason):
    df = spark.createDataFrame([(7, text)], "ordinal_ int, text string")
    assert [(r.ordinal, r.record) for r in IO.json_records(df).collect()] == records
    assert [r.reason for r in IO.json_failures(df).collect()] == ([reason] if reason else [])


def test_a_record_too_large_fails_its_file_alone(monkeypatch):
    monkeypatch.setattr(J, "MOST_FLAT", 20)
    assert J.records_in('[{"a":"x"},{"a":"%s"}]' % ("x" * 30)) == ([], "record 2 is too large")
    assert J.records_in('[{"a":"x"}]') == ([(1, '{"a":"x"}')], None)
    assert J.problem_of('{"a":"%s"}' % ("x" * 30)) == "record too large"
    monkeypatch.setattr(J, "MOST_RECORDS", 1)
    assert J.records_in('[{"a":"x"},{}]') == ([(1, '{"a":"x"}')], None) and J.records_in('[{"a":"x"},{"a":"y"}]') == ([], "too many records")


def test_lines_hold_one_value_each(spark):
    lines = {'{"a":1},{"b":2}': "invalid JSON", "1,2": "invalid JSON", '{"t":"is NaN here"}': None, '{"t":NaN}': "not a number", "-Infinity": "not a number", '"Infinity"': None, "{}": None, '{"a":1': "invalid JSON", "nul": "invalid JSON"}
    rows = spark.createDataFrame([(t, 1, t) for t in lines], "source_file string, line long, record string")
    assert {r.source_file: r.reason for r in IO.jsonl_quality(rows).collect()} == {t: w for t, w in lines.items() if w}
    more = spark.createDataFrame([("f", i, t) for i, t in enumerate(["{}", " \t", "{}", "", None], 1)] + [("g", 1, "{}"), ("g", 2, ""), ("h", 1, "x" * 50), ("i", 1, "{}"), ("i", 9, "{}")], "source_file string, line long, record string")
    assert {tuple(r) for r in IO.jsonl_quality(more, longest=20, most=8).collect()} == {("f", 2, "blank line"), ("h", 1, "long line"), ("i", 9, "too many lines")}


def test_an_earlier_flag_outlives_another(spark):
    sessions = spark.createDataFrame([("a", "Docs", True, "old"), ("b", "other", False, None)], "session string, collection string, stale boolean, stale_reason string")
    named = spark.createDataFrame([("other",)], "collection string")
    got = {r.session: r for r in G.flag_sessions(G.flag_sessions(sessions, named, "stale", "new"), named, "orphaned", "gone").collect()}
    assert (got["a"].stale, got["a"].stale_reason, got["a"].orphaned) == (True, "old", False)
    assert (got["b"].stale, got["b"].stale_reason, got["b"].orphaned, got["b"].orphaned_reason) == (True, "new", True, "gone")


def test_a_session_is_imported_again_and_again(spark):
    given = spark.createDataFrame([("s",), ("s",), ("free",)], "session string")
    here = spark.createDataFrame([("s",)], "session string")
    seen = {"s"}
    for _ in range(3):
        new = [r.session for r in G.import_sessions(given, here, "C").collect()]
        assert len(set(new)) == 3 and not seen & set(new)
        seen |= set(new)
        here = here.union(spark.createDataFrame([(x,) for x in new], "session string"))


def test_a_pair_that_changed_in_any_way_stays(spark):
    schema = "pair_id int, question string, answer string, ground_truth string, status string, contexts array<string>"
    was = [(i, "q", "a", "t", "approved", ["c"]) for i in range(4)]
    now = [was[0], (1, "q", "edited", "t", "edited", ["c"]), was[2], was[3]]
    fresh = spark.createDataFrame([(0, "Q", "A"), (1, "Q", "A"), (2, None, None)], "pair_id int, question string, answer string")
    got = sorted(map(tuple, G.regenerate_pairs(spark.createDataFrame(now, schema), fresh, spark.createDataFrame(was, schema)).collect()))
    assert got == [(0, "Q", "A", "A", "pending", ["c"]), now[1], was[2], was[3]]


def test_samples_without_seed_differ(spark):
    ids = spark.range(500).select(F.lpad(F.hex("id"), 32, "0").alias("uuid_hex"))
    a, b = ({r.uuid_hex for r in G.sample_chunks(ids, 20, None).collect()} for _ in range(2))
    assert len(a) == 20 and a != b


def test_digests_tell_values_not_forms(spark):
    rows = spark.createDataFrame([(1, 1.0, "2024-01-01T00:00:00Z", [1.0, 2.0])], "id int, n double, created_at string, vector array<double>")
    same = spark.createDataFrame([(1, 1, "2024-01-01T02:00:00+02:00", [1.0, 2.0])], "id int, n int, created_at string, vector array<float>")
    other = spark.createDataFrame([(1, "1", "2024-01-01T00:00:01", [1.0, 2.0])], "id int, n string, created_at string, vector array<float>")
    one, two, three = (S.digests(x, ["n", "created_at"]).first() for x in (rows, same, other))
    assert one == two and one.props != three.props and one.vec == three.vec
    for bad in ([1.0, None], [], None, [float("nan")], [1e39]):
        with pytest.raises(Exception, match="invalid vector"):
            S.digests(spark.createDataFrame([(1, bad)], "id int, vector array<double>"), ["id"]).collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_offset_are_utc(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = {"2024-06-01T12:00:00": 1717243200, "2024-06-01 12:00:00": 1717243200, "2024-06-01": 1717200000, "2024-06-01T12:00:00Z": 1717243200, "2024-06-01T12:00:00+02:00": 1717236000, "soon": None, None: None}
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.unix_timestamp(T.parse_iso_utc(F.col("t"))).alias("s"))
        assert {r.t: r.s for r in df.collect()} == texts
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_part_limits_are_the_longest_that_fit(spark):
    def fits(n, size, overlap):
        windows = 0 if n <= 0 else 1 if n <= size else 1 + -(-(n - size) // (size - overlap))
        return windows <= 10_000 and n + max(windows - 1, 0) * overlap <= 10_000_000

    cases = [(1500, 500), (3000, 200), (50, 49), (6000, 5999), (6000, 0), (999, 1), (1000, 0), (1001, 333)]
    df = spark.createDataFrame(cases, "size long, overlap long").withColumn("most", T.part_limit(F.lit("overlap"), F.col("size"), F.col("overlap")))
    for r in df.collect():
        assert fits(r.most, r.size, r.overlap) and not (r.most < 10_000_000 and fits(r.most + 1, r.size, r.overlap))


def test_types_by_suffix(spark):
    names = {"a.txt.gz": "", "c.csv.gz": "", "d.json.gz": "json", "e.JSONL.gz": "jsonl", "f.md": "md", "g": "", "h.gz": ""}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.t for r in df.select("name", T.source_type(F.col("name")).alias("t")).collect()} == names
    got = {r.name: (r.accepted, r.reason) for r in IO.accepted_and_skipped(df).collect()}
    assert got["d.json.gz"] == (False, "unsupported type '.gz'") and got["e.JSONL.gz"] == (True, None) and got["g"] == (False, "unsupported type 'none'")
