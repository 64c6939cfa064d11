"""Files that are cut into blocks in the middle of their records."""

import csv
import io
import json
import random

import pytest

from conftest import rows
from pyspark.sql import functions as F

from pairloom.schemas import PAIRS
from pairloom.sources import blocks, csv_format, evalset, pairs
from pairloom.sources import feedback as files
from pairloom.sources.blocks import State
from pairloom.sources.json_array import JsonArray

TEXTS = ["", "a", "a,b", 'say "x"', "two\nlines", '"', '""\n""', "\n\n\n", "é中\n\U0001f600", "x" * 90, "cr\r\nlf", '\n",\n', "   "]
PAIR = "text string, code string"


@pytest.fixture
def small_blocks(spark):
    """Blocks of some bytes, so that a small file has many."""

    def use(size):
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield use
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def csv_text(rows, columns, ends="\n"):
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_NONNUMERIC, lineterminator=ends)
    writer.writerow(columns)
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize(("size", "ends"), [(40, "\n"), (400, "\r\n")])
def test_csv_blocks_equal_the_whole_file(spark, tmp_path, small_blocks, size, ends):
    rng = random.Random(size)
    data = [(rng.choice(TEXTS), rng.choice(TEXTS)) for _ in range(12 if size < 50 else 150)]
    (tmp_path / "a.csv").write_bytes(csv_text(data, ["text", "code"], ends).encode())
    (tmp_path / "b.csv").write_bytes(csv_text([(c, 1, t) for t, c in data[:30]], ["code", "note", "text"], ends).encode())
    (tmp_path / "c.csv").write_text("text,other\nx,y\n")
    (tmp_path / "d.csv").write_text("")
    small_blocks(size)
    got = pairs.read_pairs_csv(spark, str(tmp_path / "*.csv"), PAIR)
    assert got.rdd.getNumPartitions() > 4
    assert rows(got) == sorted([*data, *data[:30]], key=repr)
    placed = csv_format.read_by_header(spark, str(tmp_path / "a.csv"), got.schema).orderBy("_pos").collect()
    assert [(r.text, r.code) for r in placed] == data


def test_a_header_has_to_end_in_the_first_block(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('text,"of\ntwo",code\n' + "a,b,c\n" * 20)
    small_blocks(6)
    with pytest.raises(ValueError, match="header"):
        pairs.read_pairs_csv(spark, str(tmp_path / "a.csv"), PAIR)


def test_one_record_over_many_blocks(spark, tmp_path, small_blocks):
    data = [("first", "1"), ("line\n" * 100, "2"), ("", "3"), ("\n" * 200 + '"', "4"), ("last", "5")]
    (tmp_path / "a.csv").write_text(csv_text(data, ["text", "code"]))
    small_blocks(100)
    got = csv_format.read_by_header(spark, str(tmp_path / "a.csv"), pairs.read_pairs_csv(spark, str(tmp_path / "a.csv"), PAIR).schema)
    assert [(r.text, r.code) for r in got.orderBy("_pos").collect()] == data


def test_quotes_within_bare_fields_and_headers_of_several_lines(spark, tmp_path, small_blocks):
    body = 'a"b,c\n' * 40 + '"q"x,"d\ne"\n' * 40 + ",\n" + '"",""\n\n\nlone\n'
    (tmp_path / "a.csv").write_text('text,code,"of two\nlines"\n' + body)
    want = [('a"b', "c")] * 40 + [('"q"x', "d\ne")] * 40 + [(None, None), ("", ""), ("lone", None)]
    for size in (40, 10_000):
        small_blocks(size)
        assert rows(pairs.read_pairs_csv(spark, str(tmp_path / "a.csv"), PAIR)) == sorted(want, key=repr)


def test_typed_columns_and_small_files_beside_large_ones(spark, tmp_path, small_blocks):
    head = "ex_id,task,prompt,answer\n"
    (tmp_path / "large.csv").write_text(head + "".join(f'{i},task_1,"p\n{i}",a\n' for i in range(300)))
    for i in range(5):
        (tmp_path / f"small{i}.csv").write_text(f"{head}{1000 + i},task_2,p,a\nx,task_2,p,a\n")
    spark.conf.set("spark.sql.files.openCostInBytes", "400")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = pairs.read_pairs_csv(spark, str(tmp_path / "*.csv"), PAIRS)
        assert got.where("ex_id is null").count() == 5
        assert sorted(r.ex_id for r in got.where("ex_id is not null").collect()) == [*range(300), *range(1000, 1005)]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_feedback_order_over_blocks(spark, tmp_path, small_blocks):
    text = "timestamp,task,prompt,response,rating\n" + "".join(f't,task_1,p{i},"r\n",1\n' for i in range(200))
    (tmp_path / "feedback_1.csv").write_text(text)
    small_blocks(333)
    loaded = files.load_feedback_csv(spark, str(tmp_path))
    assert [r.prompt for r in loaded.orderBy("file", "pos").collect()] == [f"p{i}" for i in range(200)]


def test_states_by_blocks_equal_a_plain_walk():
    rng = random.Random(5)
    form = csv_format.Csv()
    for _ in range(300):
        lines = ["".join(rng.choice('a,"') for _ in range(rng.randint(0, 8))) for _ in range(6)]
        for inside in (False, True):
            state, walked = State(inside), inside
            for line in lines:
                state = form.step(line, state)
                walked = _walk(line, walked)
            assert state.inside == walked


def _walk(line, inside):
    """One character after the other: a quote opens only at a field's start and closes where it is not doubled."""
    start, i = not inside, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                inside = False
        elif c == '"' and start:
            inside = True
        start = not inside and c == ","
        i += 1
    return inside


@pytest.mark.parametrize("size", [150])
def test_json_array_over_blocks(spark, tmp_path, small_blocks, size):
    rng = random.Random(size)
    odd = ['}{"', "\\", '\\"}', "[[", "]", "{}", "\n", "é", "", "},{"]
    samples = [
        {"id": i, "task": "code_generation", "prompt": rng.choice(odd) * rng.randint(0, 9), "function_name": rng.choice(odd),
         "test_cases": [{"input": [[1, {"a": "}"}], rng.choice(odd)], "expected": {"k": rng.choice(odd)}}] * rng.randint(0, 3)}
        for i in range(30)
    ]
    (tmp_path / "a.json").write_text(json.dumps(samples, indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(samples[:10], ensure_ascii=False, separators=(",", ":")) + "\n\n", encoding="utf-8")
    (tmp_path / "c.json").write_text(" " + json.dumps({**samples[0], "id": 900}))
    (tmp_path / "d.json").write_text(" [ ] ")
    small_blocks(size)
    got = evalset.load_eval_set(spark, str(tmp_path / "*.json"))
    found = got.select("id", "prompt", "function_name", F.to_json("test_cases").alias("cases")).collect()
    want = [*samples, *samples[:10], {**samples[0], "id": 900}]
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(map(key, found)) == sorted((s["id"], s["prompt"], s["function_name"]) for s in want)
    cases = {r.id: json.loads(r.cases) for r in found}
    assert all(cases[s["id"]] == s["test_cases"] for s in want)


@pytest.mark.parametrize(
    "text",
    ['[{"id": 1}, {"id": 2}', '[{"id": 1} {"id": 2}]', '[{"id": 1}, 5]', '[{"id": 1}, {"id": "x}]', '[{"id": "one"}]', '[{"id": 1}]]', '[{"id": 1}, {"id": 2]', 'x[{"id": 1}]'],
)
def test_broken_arrays_fail(spark, tmp_path, small_blocks, text):
    (tmp_path / "a.json").write_text(text)
    small_blocks(12)
    with pytest.raises(Exception, match="MALFORMED|CANNOT_PARSE|FAILED_READ"):
        evalset.load_eval_set(spark, str(tmp_path / "a.json")).collect()


def test_json_steps():
    form = JsonArray()
    assert form.step('[{"a": "{[', State()) == State(True, 2)
    assert form.step('\\"]', State(True, 2)) == State(True, 2)
    assert form.step('x"', State(True, 2)) == State(False, 1)


def test_unknown_blocks_fail(spark):
    pieces = spark.createDataFrame([("f", 0, "a"), ("f", 9, "b")], "path string, start long, value string")
    known = spark.createDataFrame([("f", 0, False, 0, "a")], "path string, start long, inside boolean, depth long, head string")
    with pytest.raises(Exception, match="other blocks"):
        blocks._with_states(pieces, known).collect()
