"""Quoted CSV by byte ranges: every range size gives the rows of one sequential pass."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from calibrix.sources import files as FS
from calibrix.sources import quoted_csv as Q

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("text", T.StringType())])
TEXTS = ['plain', '', None, 'a,b', 'line\nbreak', '"', '""', 'he said "no",\nthen "yes"', '\n', ' edge ', 'ü\r\nß', ',', '",\n"', '漢"字"', 'x' * 300]


def _text(rows):
    """CSV as Spark writes it: empty texts quoted, nulls empty."""
    out = []
    for r in rows:
        fields = []
        for v in r:
            s = '' if v is None else str(v)
            special = any(c in s for c in ',"\n\r') or (v is not None and s == '')
            fields.append('"' + s.replace('"', '""') + '"' if special else s)
        out.append(",".join(fields))
    return "\n".join(["id,x,text", *out]) + "\n"


def _rows(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 0.5, -1e-7, 3.0]), rng.choice(TEXTS) if rng.random() < 0.7 else "".join(rng.choice('a",\n ') for _ in range(9))) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_gives_the_same_states_and_records(tmp_path, seed):
    """States and first records from every line start, against one pass from the beginning; pieces of any size."""
    data = _text(_rows(seed, 25)).encode()
    path = tmp_path / "a.csv"
    path.write_bytes(data)
    inside, starts, at_field = False, [0], True
    states = {0: Q.OUTSIDE}
    i = 0
    while i < len(data):  # a plain automaton over bytes
        c = data[i : i + 1]
        if inside:
            if c == b'"':
                if data[i + 1 : i + 2] == b'"':
                    i += 1
                else:
                    inside = False
        elif c == b'"' and at_field:
            inside = True
        at_field = not inside and c in b",\n"
        if c == b"\n":
            states[i + 1] = Q.INSIDE if inside else Q.OUTSIDE
            if not inside:
                starts.append(i + 1)
        i += 1
    Q._STEP = 7
    with Q._opened(str(path)) as f:
        for at, state in states.items():
            assert Q.line_start(f, at, len(data)) == at
            assert Q.first_record(f, at, state, len(data)) == min(s for s in starts if s >= at)
            assert Q.ends(f, 0, at)[0] == state
        for a, b in zip(sorted(states), sorted(states)[3:]):
            assert Q.ends(f, a, b)[states[a]] == states[b]
    Q._STEP = 1 << 20


@pytest.mark.parametrize("split_bytes", [1, 17, 64, 1000, 1 << 20])
def test_every_split_size_reads_the_same_rows(spark, tmp_path, split_bytes):
    rows = _rows(9, 60 if split_bytes > 1 else 12)
    (tmp_path / "a.csv").write_text(_text(rows), newline="")
    df = Q.read_quoted_csv(spark, str(tmp_path), SCHEMA, split_bytes)
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(*r, None) for r in rows]
    n = df.rdd.getNumPartitions()
    assert n == 1 if split_bytes == 1 << 20 else n > 1


def test_as_spark_writes_and_reads(spark, tmp_path):
    """The round trip through Spark's writer; Spark's own, unsplit reader differs in empty texts only, which it makes null."""
    rows = [r for r in _rows(5, 200)]
    df = spark.createDataFrame(rows, SCHEMA)
    FS.write_csv(df.coalesce(1), str(tmp_path / "t"))
    own = sorted(tuple(r) for r in Q.read_quoted_csv(spark, str(tmp_path / "t"), SCHEMA, 100, damaged=None).collect())
    unsplit = spark.read.schema(SCHEMA).options(**FS.CSV_OPTIONS).csv(str(tmp_path / "t"))
    assert own == sorted(rows)
    assert [(i, x, t or None) for i, x, t in own] == sorted(tuple(r) for r in unsplit.collect())


def test_damaged_rows(spark, tmp_path):
    body = 'id,x,text\n1,0.5,good\n2,zero,"bad, number"\n3,1.0\n4,1.0,a,b\n"5",2.0,"tail"s\n\n6,,"quo"",ted"\r\n7,3.0,un"quoted"\n'
    (tmp_path / "a.csv").write_text(body, newline="")
    for size in (5, 20, 1000):
        got = {r.id: tuple(r)[1:] for r in Q.read_quoted_csv(spark, str(tmp_path), SCHEMA, size).collect()}
        assert got == {1: (0.5, "good", None), 2: (None, "bad, number", '2,zero,"bad, number"'), 3: (1.0, None, "3,1.0"),
                       4: (1.0, "a", "4,1.0,a,b"), 5: (2.0, "tails", None), 6: (None, 'quo",ted', None), 7: (3.0, 'un"quoted"', None)}


def test_an_open_quote_to_the_end_of_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,text\n1,1.0,"never closed\n2,2.0,b\n3,3.0,c\n')
    for size in (8, 1000):
        got = [tuple(r) for r in Q.read_quoted_csv(spark, str(tmp_path), SCHEMA, size).collect()]
        assert len(got) == 1 and got[0][:2] == (1, 1.0) and got[0][2].startswith("never closed\n2,2.0,b")


def test_header_empty_files_and_folders(spark, tmp_path):
    schema = T.StructType([*SCHEMA.fields, T.StructField("split", T.StringType())])
    for part, rows in (("a", _rows(1, 9)), ("b", _rows(2, 5)), ("none", [])):
        (tmp_path / f"split={part}").mkdir()
        (tmp_path / f"split={part}" / "x.csv").write_text(_text(rows), newline="")
    (tmp_path / "split=a" / "empty.csv").write_text("")
    got = sorted((r.split, r.id) for r in Q.read_quoted_csv(spark, str(tmp_path), schema, 50, damaged=None, folders=("split",)).collect())
    assert got == [*(("a", i) for i in range(9)), *(("b", i) for i in range(5))]
    assert FS.read_split(spark, str(tmp_path), "b", "csv", SCHEMA).count() == 5
    (tmp_path / "split=b" / "y.csv").write_text("id,y,text\n1,2,3\n")
    with pytest.raises(Exception, match="header"):
        Q.read_quoted_csv(spark, str(tmp_path), schema, folders=("split",)).collect()


def test_fields_as_the_csv_module_splits_them():
    text = _text(_rows(3, 50))
    got = [r for r, _ in Q.records(iter(text.splitlines(keepends=True)), [])] if "\r" not in text else None
    if got is not None:
        plain = list(csv.reader(io.StringIO(text, newline="")))
        assert [[v or "" for v in r] for r in got] == plain


def test_typed_values():
    rows = [["1", "NaN", "a"], ["-2", "Infinity", None], [None, "1e-3", ""]]
    batch = Q.typed(rows, ["", "", ""], pa.schema([("id", pa.int64()), ("x", pa.float64()), ("text", pa.string())]), None)
    assert batch.column("id").to_pylist() == [1, -2, None] and batch.column("text").to_pylist() == ["a", None, ""]
    assert str(batch.column("x").to_pylist()) == "[nan, inf, 0.001]"
