import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _f string, digest int, size string, rep long"


def prose(seed: int, n: int) -> str:
    g = random.Random(seed)
    return " ".join("".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(2, 8))) for _ in range(n))


LONG = prose(99, 6000)


def cases() -> list[tuple]:
    """Nulls in any column, empty and very long texts, near and exact copies, repeated rows, ties."""
    base = [prose(i, 60) for i in range(6)]
    near = base[0].split(" ")
    near[30] = "changed"
    texts = [
        (3, base[0]), (1, base[1]), (7, " ".join(near)), (9, base[0].replace(" ", "\n \t", 3)), (2, None), (4, ""), (5, " \n\t "), (6, "one two"), (8, "One  TWO"),
        (10, base[2] + " " + base[3]), (11, base[4] + " " + base[3]), (12, LONG), (13, LONG), (14, "Ünïcödé 😀 text ▁ with é"), (15, "1234 -- !!"), (16, base[5]), (16, base[5]),
        (17, base[1].upper()), (None, base[1]), (None, "alone without an id " + base[2]), (18, "word"), (19, "word"), (20, "aaaa" * 100),
    ]
    return [(i, t, [None, "en", "xx"][k % 3], [None, "a", "b", "c"][k % 4], None, "no", "f", None if k % 2 else 3, "big", k) for k, (i, t) in enumerate(texts)]


@pytest.fixture
def write(spark, tmp_path):
    def put(rows: list[tuple], name: str = "documents.parquet", parts: int = 3) -> str:
        """Rows of SCHEMA, or (doc_id, text), as a folder of a few files; returns the folder above."""
        full = [r if len(r) > 2 else (*r, "en", "a", len(r[1] or ""), "x", "y", 1, "z", 0) for r in rows]
        spark.createDataFrame(full, SCHEMA).repartition(parts).write.mode("overwrite").parquet(str(tmp_path / name))
        return str(tmp_path)

    return put


@pytest.fixture
def corpus(write):
    return write(cases())


@pytest.fixture
def empty(write):
    return write([], parts=1)
