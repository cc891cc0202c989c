import csv
import io
import os
import random

import duckdb
import pytest

from docweave.sources.csv_records import csv_file_rows, scanned


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def rows_of(spark, folder, **files):
    for name, text in files.items():
        with open(os.path.join(folder, f"{name}.csv"), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    got = sorted((os.path.basename(r.path)[:-4], r.row_no, r.line, r.fallback) for r in csv_file_rows(spark, str(folder)).collect())
    out = {}
    for name, number, line, fallback in got:
        assert number == len(out.setdefault(name, ([], fallback))[0])
        out[name][0].append(line)
    return out


def big_file(seed, n=400, sep=";"):
    rng = random.Random(seed)
    cells = ["x", "two words", "semi;colon", "com,ma", 'say "hi"', "line\nbreak", "a\n\n\nb", "ç中", '"', "\n", '\n"\n']
    rows = [["id", "first name", "note"]] + [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(n)]
    text = io.StringIO()
    csv.writer(text, delimiter=sep, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows(rows)
    return text.getvalue()


def test_records_span_lines_and_files_span_tasks(small_blocks, tmp_path):
    text = big_file(1)
    got = rows_of(small_blocks, tmp_path, big=text)["big"]
    want = duckdb.execute("SELECT * FROM read_csv(?, delim=';', header=true, all_varchar=true, quote='\"', escape='\"', new_line='\\n', auto_detect=false, columns={'id': 'VARCHAR', 'first name': 'VARCHAR', 'note': 'VARCHAR'})", [str(tmp_path / "big.csv")]).fetchall()
    assert len(want) == 400 and not got[1]
    assert got[0] == [f"id: {a} | first name: {b} | note: {c}" for a, b, c in want]
    assert small_blocks.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 20


def test_header_labels_index_and_fallback(small_blocks, tmp_path):
    got = rows_of(
        small_blocks, tmp_path,
        label='Sheet: a; "b\nprose "here\nx;y\n5;"6\n6"\n\n7;8\n' + "9;10\n" * 100,
        comma="a,b\r\n1,2\r\n,NA\r\n",
        index="a,b\n1,2,3\n4,5\n",
        long='a,b\n1,"2\n2"\n1,2,3\n\n',
        stray='a,b\n1,"2\n' + "3,4\n" * 200,
        plain="title\nvalue\n",
        wide='a,"b\nc"\n1,2\n',
    )
    assert got["label"] == (["x: 5 | y: 6\n6", "x: 7 | y: 8"] + ["x: 9 | y: 10"] * 100, False)
    assert got["comma"] == (["a: 1 | b: 2", ""], False)
    assert got["index"] == (["a: 2 | b: 3", "a: 5"], False)
    assert got["long"] == (["a, b", "1, 2\n2", "1, 2, 3", ""], True)
    assert got["stray"][1] and len(got["stray"][0]) == 202 and got["stray"][0][-1] == "3, 4"
    assert got["plain"] == (["title: value"], False)
    assert got["wide"] == (["a: 1 | b\nc: 2"], False)


def test_one_quoted_cell_over_many_blocks(small_blocks, tmp_path):
    body = "\n".join(f"line {i}, with; marks" for i in range(300))
    got = rows_of(small_blocks, tmp_path, one=f'k;v\n1;"{body}"\n2;z\n')["one"]
    assert got == ([f"k: 1 | v: {body}", "k: 2 | v: z"], False)


def test_lines_are_joined_to_their_blocks_without_a_shuffle(small_blocks, tmp_path):
    (tmp_path / "big.csv").write_text(big_file(2))
    plan = csv_file_rows(small_blocks, str(tmp_path)).select("line", "fallback")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_scan_notes_parity_and_the_last_line_of_either_parity_by_block(spark):
    text = ['a"', "b", '"c', 'd""', '"', "e", 'f"', "g"]
    rows = [("p", i // 5, 10 + i, line) for i, line in enumerate(text)] + [("q", 1, 30, '"'), ("q", 1, 31, "h")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "path string, block long, id long, line string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = [(r.id, r.inside, r.own0, r.own1) for r in scanned(df).collect()]
            want, state = [], {}
            for path, block, i, line in rows:
                quotes, last = state.get((path, block), (0, [None, None]))
                last = [i if quotes % 2 == p else last[p] for p in (0, 1)]
                want.append((i, quotes % 2, *(-1 if x is None else i - x for x in last)))
                state[path, block] = quotes + line.count('"'), last
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
