"""CSV files cut anywhere give the rows that a reader of whole files gives."""

import csv
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scriptledger.sources import csv_splits, files

HEADER = {"NPI": "npi", "Name, full": "name", "Note": "note"}
PIECES = ["a", "b,c", '"', '""', "\n", "\n\n", "x\ny", " ", "é", "long words here", '",', ',"', "1"]


@pytest.fixture
def cut(spark):
    """Sets the bytes of a range."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {name: spark.conf.get(name) for name in names}
    yield lambda size: [spark.conf.set(name, size) for name in names]
    for name, value in before.items():
        spark.conf.set(name, value)


def whole(spark, path):
    """Rows of a reader that takes a file as one."""
    read = spark.read.options(header=True, encoding="ISO-8859-1", escape='"', multiLine=True).csv(str(path))
    return sorted((tuple(r) for r in read.select([read[f"`{c}`"] for c in HEADER]).collect()), key=str)


def split(spark, *paths):
    found = files.read_text_columns(spark, [str(p) for p in paths], HEADER)
    assert found.columns == list(HEADER.values())
    return sorted((tuple(r) for r in found.collect()), key=str)


def written(path, rows, line_end="\n", quoting=csv.QUOTE_MINIMAL, header=("Other", *HEADER)):
    with open(path, "w", encoding="latin-1", newline="") as out:
        writer = csv.writer(out, lineterminator=line_end, quoting=quoting)
        writer.writerow(header)
        writer.writerows(rows)
    return path


def drawn(seed, n=60):
    draw = random.Random(seed)
    return [[i, *("".join(draw.choice(PIECES) for _ in range(draw.randint(0, 5))) for _ in range(3))] for i in range(n)]


@pytest.mark.parametrize(("seed", "size"), [(0, 16), (1, 61), (2, 500), (3, 16), (3, 61)])
def test_cut_at_any_place(spark, cut, tmp_path, seed, size):
    path = written(tmp_path / "a.csv", drawn(seed), ["\n", "\r\n"][seed % 2], [csv.QUOTE_MINIMAL, csv.QUOTE_ALL][seed // 2])
    expected = whole(spark, path)
    cut(size)
    assert split(spark, path) == expected


def test_a_quoted_break_at_every_border(spark, cut, tmp_path):
    """Each range starts within quotes, some hold no end of them."""
    rows = [[i, "n" * (i % 7), f"first {i}\nsecond\n\nthird\n" * (1 + i % 5), "\n" * (i % 4)] for i in range(40)]
    path = written(tmp_path / "a.csv", rows)
    expected = whole(spark, path)
    assert len(expected) == 40
    cut(16)
    found = files.read_text_columns(spark, str(path), HEADER)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    text = spark.read.text(str(path))
    assert text.rdd.getNumPartitions() > 20


def test_a_record_over_many_ranges(spark, cut, tmp_path):
    rows = [[1, "a", "line without quotes\n" * 100, "x"], [2, "b", "c", "d"], [3, "b", "\n" * 300, "d"]]
    path = written(tmp_path / "a.csv", rows)
    expected = whole(spark, path)
    cut(64)
    assert split(spark, path) == expected and len(expected) == 3


def test_ranges_with_many_borders_are_not_listed(spark, cut, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_splits, "LISTED_RANGES", 2)
    path = written(tmp_path / "a.csv", drawn(9))
    expected = whole(spark, path)
    cut(40)
    assert split(spark, path) == expected


def test_several_files_with_headers_of_their_own(spark, cut, tmp_path):
    one = written(tmp_path / "a.csv", drawn(1))
    two = written(tmp_path / "b b.csv", drawn(2), header=("Note", "NPI", "Name, full", "More"))
    three = written(tmp_path / "c.csv", drawn(3, 5), header=("Other", *HEADER))
    expected = sorted(whole(spark, one) + whole(spark, two) + whole(spark, three), key=str)
    cut(50)
    assert split(spark, one, two, three) == expected


@pytest.mark.parametrize(
    "text",
    [
        'NPI,"Name, full",Note\n1,5" pipe,x\n2,a"b"c,"q"\n3,"say ""hi""\nthere",y\n',
        'NPI,"Name, full",Note\n1,"a" tail,x\n2,"b"tail "more",y\n3,c,"d\ne"\n',
        '\n\nNPI,"Name, full",Note\n\n1,a,b\n\n\n2,c\n3,d,e,surplus,"more\nof it"\n',
        'NPI,"Name, full",Note\n1,"",\n2,,""\n3," ", "x"\n',
        'NPI,"Name, full",Note\r\n1,"a\r\nb",c\r\n2,d,e',
        'NPI,"Name, full",Note\n',
        'NPI,"Name, full",Note',
    ],
)
@pytest.mark.parametrize("size", [8, 1000])
def test_odd_files(spark, cut, tmp_path, text, size):
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    expected = whole(spark, path)
    cut(size)
    assert split(spark, path) == expected


def test_missing_columns_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("NPI,Note\n1,2\n")
    (tmp_path / "b.csv").write_text("")
    with pytest.raises(ValueError, match="a.csv lacks columns"):
        split(spark, tmp_path / "a.csv")
    with pytest.raises(ValueError, match="lacks columns"):
        split(spark, tmp_path / "b.csv")


def test_another_cut_than_in_the_first_scan_is_an_error(spark, cut, tmp_path):
    path = written(tmp_path / "a.csv", drawn(5))
    cut(50)
    found = files.read_text_columns(spark, str(path), HEADER)
    cut(37)
    with pytest.raises(Exception, match="cut into other ranges"):
        found.collect()


def plain_states(lines, start):
    """State before each line by reading character by character."""
    out, inside = [], start
    for line in lines:
        out.append(inside)
        at, field = 0, not inside
        while at < len(line):
            c = line[at]
            if inside:
                if c == '"':
                    if line[at + 1 : at + 2] == '"':
                        at += 1
                    else:
                        inside = False
            elif field and c == '"':
                inside = True
            field = not inside and c == ","
            at += 1
    return [*out, inside]


@pytest.mark.parametrize("seed", range(200))
def test_states_equal_a_character_by_character_reader(seed):
    draw = random.Random(seed)
    lines = ["".join(draw.choice('"",a ') for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(0, 12))]
    # Text right behind a closing quote up to the next comma is the field's.
    lines = [re.sub(r'(?<=a)"+', "", x) for x in lines]
    opens, stays = csv_splits.effects(pa.array([x.encode() for x in lines], pa.binary()))
    for start in (False, True):
        assert csv_splits.states(opens, stays, start).tolist() == plain_states(lines, start)


def test_nothing_is_parsed_in_one_task(spark, cut, tmp_path):
    path = written(tmp_path / "a.csv", drawn(3, 400))
    cut(1000)
    found = files.read_text_columns(spark, str(path), HEADER)
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 5 and max(sizes) < 0.5 * sum(sizes)
    assert np.sum(sizes) == 400
