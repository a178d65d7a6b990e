import random

import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, key string, raw string, rep string, row long, "
           "w long, size long, bucket string, node long, at long, paths string, rid string, unit string, score string, "
           "__d string, n_tokens string, kept string")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """(doc_id, text): nulls, empty and very long texts, exact and near copies, repeated rows, odd characters."""
    rng = random.Random(11)
    base = [words(rng, rng.choice((3, 30, 60, 120, 300))) for _ in range(40)]
    near = base[3].split()
    edited = near[:]
    edited[len(edited) // 2] = "changed"
    passage = words(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(50, base[2]), (51, base[2].upper()), (52, " ".join(edited)), (53, passage + " " + base[5]),
             (54, base[6] + "\n" + passage), (55, " ".join(["spam ham"] * 200)), (56, "x" * 5000), (57, words(rng, 20000)),
             (58, "\n".join(["same line here"] * 30)), (59, "日本語 テキスト 🙂 a\x00b <s> ▁ é́"), (60, "one"), (61, "one"),
             (62, "Licensed under the Apache License, Version 2.0."), (63, "#*$ |<>& %"), (64, "\u00a0\u2003 \t\r\n\x0b\x0c x")]
    rows += [(70, None), (71, ""), (72, "   \n\t "), (None, base[4]), (None, "only here " * 20), (None, None), (0, base[0])]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows with the columns of documents and others whose names the operators use inside."""
    n = len(COLUMNS.split(",")) - 2
    return spark.createDataFrame([(i, t, *[None] * n) for i, t in messy_rows], COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def none(messy):
    return messy.limit(0)
