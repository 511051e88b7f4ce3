import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mintscope.llm import linededup
from mintscope.llm.queries import ORACLES, op7_line_dedup

SF = "/root/testdata/sf0.01"


def near(x, y, edits=1):
    """Whether at most `edits` single-character edits turn x into y."""
    if abs(len(x) - len(y)) > edits:
        return False
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row = _next(row, i, a, y)
    return row[-1] <= edits


def _next(row, i, a, y):
    out = [i]
    for j, b in enumerate(y, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (a != b)))
    return out


def brute(rows, edits=1):
    seen, out = [], {}
    for d, text in sorted(rows):
        left = []
        for line in text.split("\n"):
            if not any(c.isalnum() for c in line):
                left.append(line)
                continue
            if line not in seen and not any(near(line, s, edits) for s in seen):
                left.append(line)
            seen.append(line)
        out[d] = "\n".join(left)
    return out


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_edits_against_brute_force(spark, edits):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé ") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 60]))) for _ in range(25)] + ["aaaaaaaaaaaaaaaaaaaaaa"] + ["x" * 500] * (edits < 2)
    def edit(s):
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(max(1, len(s)))
            s = rng.choice([s[:p] + s[p + 1 :], s[:p] + rng.choice("abq") + s[p:], s[:p] + rng.choice("abq") + s[p + 1 :]])
        return s
    rows = [(d, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.clean(df, edits=edits).collect()}
    assert got == brute(rows, edits)


def test_short_lines_are_near_too(spark):
    rows = [(1, "Copyright 2024 Foo\nShare this page now\na"), (2, "Copyright 2025 Foo\nShare this page now!\nb\nab\nabc\nabcd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit(7), "n_removed": F.lit(8)})
    done = linededup.clean(df)
    assert done.columns == ["doc_id", "text", "n_lines", "n_removed", "_n_lines", "_n_removed"]
    assert sorted((r.text, r.n_lines, r.n_removed, r._n_lines, r._n_removed) for r in done.collect()) == [("", 7, 8, 6, 6), ("Copyright 2024 Foo\nShare this page now\na", 7, 8, 3, 0)]
    assert linededup.drop_repeated_lines(df).columns == df.columns


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op7_line_dedup"]).fetchall())
    assert sorted(tuple(r) for r in op7_line_dedup(spark, SF).collect()) == want


def test_edge_rows(spark):
    long = "a line of more than twenty characters"
    rows = [(1, None, "t"), (2, "", "t"), (3, "short\n\n--\nshort\n\n--\nShort\nshor", "t"), (4, long, "t"), (4, long, "t"), (5, long[:-1] + "\nmine alone, and long enough too", "t"), (6, long, None), (None, None, None), (7, "short", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string").withColumn("kept", F.lit(0))
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in linededup.clean(df).collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (2, "", 1, 0), (3, "short\n\n--\n\n--", 8, 3), (4, long, 1, 0), (4, long, 1, 0), (5, "mine alone, and long enough too", 2, 1), (6, "", 1, 1), (0, None, 0, 0), (7, "", 1, 1)], key=str)
    kept = linededup.drop_repeated_lines(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5]
    assert linededup.clean(df.where("false")).count() == 0


def test_keys_of_lines_are_not_broadcast(spark):
    """Failed before: the planner sized a line's block keys like the line, and sent them through the driver."""
    rows = spark.range(1000).selectExpr("struct(id as h, id as g) as id", "explode(sequence(id, id + 31)) as block")
    shared = linededup._shared(rows, "block")
    assert "Join" in (plan := shared._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan
    assert shared.count() == 32 * 1000 - 2
