import random
import re

import pytest
from pyspark.sql import functions as F

from loomwright.operators import markdown as M


def run(spark, text, least, most):
    row = spark.createDataFrame([(text,)], "t string").select(M.sections(F.col("t")).alias("s"), M.chunks(F.col("t"), M.ChunkSizes(least, most)).alias("c")).first()
    return row.s, [(c.chunk_type, c.heading, c.start_index, c.end_index, len(c.content)) for c in row.c]


@pytest.mark.parametrize(
    "text, least, most, expected",
    [
        ("# A\n\n" + "x" * 120 + "\n\n[code]\n# not a heading\ny = 1\n[/code]\n", 20, 500, [("text", "A", 0, 134, 134), ("text", "not a heading", 0, 31, 31)]),
        ("# Big\n\n" + "w" * 900, 100, 500, [("text", "Big", 5, 913, 908)]),
        ("# T\n\n" + "a" * 40 + "\n\n# U\n\n" + "b" * 40, 80, 500, [("text", None, None, None, 92)]),
        ("#### Deep\n\n" + "z" * 120, 100, 500, [("text", "Deep", 0, 120, 120)]),
        ("# M\n\n" + "p" * 150 + "\n[code]\n" + "c" * 200 + "\n[/code]\n" + "q" * 150, 100, 300, [("text", "M", 0, 156, 156), ("code", "M", 156, 370, 214), ("text", "M", 370, 526, 156)]),
        ("# M\n\n" + "p" * 150 + "\n[code]\n" + "c" * 200 + "\n[/code]\n" + "q" * 150, 100, 380, [("code", "M", 0, 366, 366), ("text", "M", 366, 522, 156)]),
        ("  \n ", 100, 500, []),
        ("Short", 100, 500, []),
        (None, 100, 500, []),
    ],
)
def test_fixtures(spark, text, least, most, expected):
    assert run(spark, text, least, most)[1] == expected


def test_heading_before_heading_vanishes(spark):
    sections = run(spark, "# A\n## B\nbody text\n# C", 1, 500)[0]
    assert [(s.heading, s.level, s.content) for s in sections] == [("B", 2, "body text")]


def model(text):
    """Line by line: what a section is."""
    out, current, has = [], (None, 0), []
    for line in text.split("\n"):
        m = re.match(r"^(#{1,6})\s+(.+)$", line)
        if m:
            if has:
                out.append((*current, "\n".join(has).strip()))
            current, has = (m[2].strip(), len(m[1])), []
        else:
            has.append(line)
    if has:
        out.append((*current, "\n".join(has).strip()))
    return out


def test_sections_of_random_texts(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["# A", "##  b c ", "#", "#x", "body", "", " # no", "####### seven", "###### six", "#\tTab"]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", M.sections(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [(s.heading, s.level, s.content) for s in r.s] == model(texts[r.i]), texts[r.i]


def test_sizes_are_checked():
    with pytest.raises(ValueError):
        M.ChunkSizes(500, 100)


def test_ids_collide_across_sections(spark):
    docs = spark.createDataFrame([("d", "# A\n\n" + "x" * 30 + "\n\n# B\n\n" + "y" * 30)], "source_id string, content string")
    assert [r.chunk_id for r in M.chunk_documents(docs, sizes=M.ChunkSizes(10, 100)).collect()] == ["d_0", "d_0"]


def test_stats_of_no_chunks(spark):
    row = M.chunk_stats(spark.createDataFrame([], "content string, chunk_type string")).first()
    assert set(row) == {0}
