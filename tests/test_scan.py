"""Scans over rows: one group with a third of all rows, ties, nulls, and ranges against one task."""

import random

from pyspark.sql import functions as F

from loomwright.operators import markdown, rag, scan


def _talk(n=900):
    rng = random.Random(4)
    rows = [(7 if k % 3 == 0 else rng.choice((1, 2, None)), k, rng.choice(("system", "user", "assistant")), rng.choice((None, "", f"text {k}", f"a\nb {k}"))) for k in range(n)]
    rng.shuffle(rows)
    return rows


def test_running_sums(spark):
    rows = _talk()
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("scan_part", F.lit("mine"))
    want, sums = [], {}
    for conv, turn, _, text in sorted(rows, key=lambda r: r[1]):
        want.append((conv, turn, *sums.get(conv, (0, 0))))
        a, b = sums.get(conv, (0, 0))
        sums[conv] = (a + len(text or ""), b + 1)
    for tasks in (1, 7):
        got = scan.running(df, "conv_id", ["turn"], {"start": F.length("text"), "no": F.lit(1)}, tasks)
        assert got.columns == [*df.columns, "start", "no"]
        assert sorted(map(repr, ((r.conv_id, r.turn, r.start, r.no) for r in got.collect()))) == sorted(map(repr, want))
    assert scan.running(df.limit(0), "conv_id", ["turn"], {"start": F.lit(1)}).count() == 0
    # The large group is several ranges.
    placed, part = scan.dealt(df, "conv_id", ["turn"], 7)
    assert part == "scan_part_" and placed.where("conv_id = 7").select(part).distinct().count() >= 3


def test_concatenation(spark):
    rows = _talk()
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: r[1]):
        one = want.setdefault(conv, ([], [], [0]))
        if role == "system":
            one[0].extend([text] if text is not None else [])
        else:
            one[1].extend([f"{role}: {text}"] if text is not None else [])
            one[2][0] += 1
    for tasks in (1, 9):
        got = {r.conv_id: (r.system, r.conversation, r.n_messages) for r in rag.chat(df, tasks=tasks).collect()}
        assert got == {k: ("\n\n".join(a), "\n".join(b), c[0]) for k, (a, b, c) in want.items()}


def test_sections_of_pieces_are_those_of_the_document(spark):
    rows = [(conv, k, f"## h{k}\n\n" + random.Random(k).choice(("", "text", "# x\n## y\nz", "one\n\n### deep\n\ntwo\n"))) for k in range(200) for conv in (1, 1 + k % 2)]
    rows = list({(c, k): (c, k, t) for c, k, t in rows}.values())
    df = spark.createDataFrame(rows, "conv_id int, turn int, content string")
    docs = scan.concatenated(df, "conv_id", ["turn"], {"content": (F.col("content"), "\n\n")}).withColumn("content", F.concat("content", F.lit("\n")))
    want = docs.select("conv_id", F.explode(markdown.sections(F.col("content"))).alias("s")).select("conv_id", "s.*")
    got = markdown.section_rows(df, "conv_id", ["turn"], tasks=6).drop("turn")
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(r) for r in want.collect())))
