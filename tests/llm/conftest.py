import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rep long, n long, score double, shard long"


def make_rows():
    """Texts of invented words with exact and near copies, shared passages, nulls, blanks, repeated rows and a very long text."""
    r = random.Random(5)
    words = ["".join(r.choice(["ka", "lo", "mi", "re", "tun", "es", "pra", "vö"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ".", ",\n"]) for _ in range(n))
    rows, base, passage = [], text(120), text(60)
    near = base.split(" ")
    for i in range(40):
        t = text(r.randint(1, 150))
        if i % 8 == 1:
            t = base
        elif i % 8 == 2:
            w = list(near)
            w[r.randrange(len(w))] = f"changed{i}"
            t = " ".join(w)
        elif i % 8 == 3:
            t = f"{text(30)} {passage} {text(20)}"
        elif i == 4:
            t = text(30_000)
        elif i == 5:
            t = 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and ' + text(40)
        elif i == 6:
            t = " ".join(["same words again and again here"] * 40)
        elif i == 8:
            t = "%%% ".join(words[:60]) + "x" * 300 + "\x1c   日本 😀 'tis I'll  two  spaces "
        rows.append((i, t, ["en", "de", None][i % 3], ["a", "b", None, "Z", "é"][i % 5]))
    rows += [(40, None, "en", "a"), (41, "", None, None), (42, " \t\n ", "de", "b"), (None, base, "en", "a"), (None, "no id", "en", "b"), (0, rows[0][1], rows[0][2], rows[0][3])]
    return [(i, t, lang, s, len(t) if t else 0, 7, 7, 7, 0.5, 1) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
