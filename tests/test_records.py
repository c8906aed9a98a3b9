"""CSV records with line breaks in cells, cut into blocks of a few bytes, against Python's reader."""

import csv
import io
import random

import pytest

from dealflow.sources import csv as files
from dealflow.sources import records
from dealflow.sources.records import leaves_open, read_records, read_table


@pytest.fixture(params=[47, 1 << 20])
def blocks(spark, request):
    """Bytes per block: in small ones records are cut, and some blocks lie within a cell."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "1")
    yield request.param
    for name, value in zip(names, old, strict=True):
        spark.conf.set(name, value)


def plain(text):
    return [row for row in csv.reader(io.StringIO(text, newline="")) if row]


def cells_of(spark, path):
    return [r["cells"] for r in files.read_url_rows(spark, path).orderBy("seq").collect()]


def test_whether_a_line_leaves_a_cell_open():
    rng = random.Random(1)
    for _ in range(4000):
        line = "".join(rng.choice('",ab ') for _ in range(rng.randrange(12)))
        for before in (False, True):
            text = '"' + line if before else line
            # A cell is open if a second line still belongs to the record.
            want = len(list(csv.reader(io.StringIO(text + "\nx", newline="")))) == 1 if text else False
            assert leaves_open(line, before) == want, (line, before)


def test_random_records(spark, tmp_path, blocks):
    rng = random.Random(blocks)
    want = []
    for name in ("a", "b"):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        for _ in range(25):
            writer.writerow(["".join(rng.choice('ab",\n\r é') for _ in range(rng.choice([0, 3, 9, 90]))) + "x" for _ in range(rng.randrange(1, 4))])
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
        want += plain(out.getvalue())
    rows = files.read_url_rows(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["cells"] for r in rows] == want and [r["seq"] for r in rows] == list(range(len(want)))


@pytest.mark.parametrize(
    "text",
    [
        'a,b"c\n5" pipe,"d"e"f\nlast,"x""y"\n', "\n\n\na\n\nb\n", 'a\rb,"c\rd"\re\n', '"' + "long\n" * 40 + '",z\nnext\n', '""\n"",""\n', "a",
        'x,"a,\n""\n,b"\n"\n\n"\n',
    ],
)
def test_oddities(spark, tmp_path, blocks, text):
    (tmp_path / "f.csv").write_bytes(text.encode())
    assert cells_of(spark, str(tmp_path / "f.csv")) == plain(text)


def test_a_cell_never_closed_ends_with_its_file(spark, tmp_path, blocks):
    (tmp_path / "a.csv").write_text('1,"open\nto the end, of the file\nx')
    (tmp_path / "b.csv").write_text("2\n")
    found = cells_of(spark, str(tmp_path))
    assert found[0][0] == "1" and found[0][1].rstrip() == "open\nto the end, of the file\nx" and found[1:] == [["2"]]


def test_every_file_has_its_own_header(spark, tmp_path, blocks):
    (tmp_path / "a.csv").write_text('A,"B\nb",A\n1,2,3\n"4\n4",5\n')
    (tmp_path / "b.csv").write_text('"B\nb",C\n6,7\n')
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("A\n")
    if blocks < 100:
        (tmp_path / "a.csv").write_text("A,Bb,A\n1,2,3\n\"4\n4\",5\n")
        (tmp_path / "b.csv").write_text("Bb,C\n6,7\n")
    named = {"A": "a", "B\nb" if blocks > 100 else "Bb": "b"}
    found = [tuple(r) for r in read_table(spark, str(tmp_path), named).orderBy("seq").collect()]
    assert found == [(0, "3", "2"), (1, None, "5"), (2, "", "6")]


def test_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_records(spark, str(tmp_path)).count() == 0
    assert files.read_listing_csv(spark, str(tmp_path)).count() == 0


def test_many_headers_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_HEADERS", 2)
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"h{i}\n1\n")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), {"h0": "a"})


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, blocks):
    (tmp_path / "f.csv").write_text('a,"b\nc"\n' * 60)
    rows = read_records(spark, str(tmp_path / "f.csv"))
    assert rows.count() == 60
    if blocks < 100:
        assert rows.rdd.getNumPartitions() > 6


def test_few_rows_of_a_batch_are_texts_at_once():
    import pyarrow as pa

    from dealflow.sources import records

    count = 3 * records.ROWS + 7
    texts = [f'{i},"a\nb"' if i % 2 else f"{i},c" for i in range(count)]
    lines = "\n".join(texts).split("\n")
    batch = pa.RecordBatch.from_pydict({"_file": ["f"] * len(lines), "_block": [0] * len(lines), "open": [False] * len(lines), "text": lines})
    found = list(records._pieces(iter([batch])))
    assert max(len(b) for b in found) <= records.ROWS
    assert [t for b in found for t in b["text"].to_pylist()] == texts
    parts = list(records.cells.func(iter([pa.array(texts)])))
    assert max(map(len, parts)) <= records.ROWS
    assert [c for p in parts for c in p.to_pylist()] == [[str(i), "a\nb" if i % 2 else "c"] for i in range(count)]
