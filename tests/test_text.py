import pytest
from pyspark.sql import functions as F

from loomwork.functions import text, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, expected",
    [("膳食脂肪 Être 盐 bge-m3 1.5", "膳食 食脂 脂肪 tre 盐 bge m3 1 5".split()), ("", []), ("!? ,", []), ("AbC", ["abc"])],
)
def test_tokenize(spark, value, expected):
    assert one(spark, value, text.tokenize) == expected


@pytest.mark.parametrize(
    "length, expected",
    [(400, [(0, 400)]), (401, [(0, 401)]), (499, [(0, 499)]), (500, [(0, 400), (350, 500)]), (760, [(0, 400), (350, 760)]), (849, [(0, 400), (350, 849)]), (850, [(0, 400), (350, 750), (700, 850)])],
)
def test_windows(spark, length, expected):
    body = "".join(chr(0x4E00 + i) for i in range(length))
    assert one(spark, body, text.windows) == [body[a:b] for a, b in expected]


@pytest.mark.parametrize("lengths, expected", [((50, 80, 10), [142]), ((5,), []), ((30,), [30]), ((), [])])
def test_merge_short(spark, lengths, expected):
    got = one(spark, ["x" * n for n in lengths], text.merge_short, "array<string>")
    assert [len(x) for x in got] == expected


def test_clean(spark):
    assert one(spark, " a \t b \n\n\n\n  \n c　\n\n d", text.clean) == "a b\n\nc\n\nd"


def test_null_text_gives_null(spark):
    assert one(spark, None, text.clean) is None


def test_table_shape(spark):
    table = "\n".join(["能量 120"] * 7)
    assert one(spark, table, text.looks_like_table) is True
    assert not one(spark, "a\nb", text.looks_like_table)
    assert not one(spark, "\n".join(["很长的一句话说明了很多很多很多很多的内容。"] * 7), text.looks_like_table)


def test_slug(spark):
    assert [one(spark, x, text.slug) for x in ("dietary_guide", "力量训练基础", "My File-2", "指南")] == ["diet", "strength", "myfile2", "src"]


def test_overlap_length(spark):
    rows = spark.createDataFrame([("ab cdef", "xxbcd e yy"), ("", "a"), (None, "a")], "a string, b string")
    assert [r[0] for r in rows.select(text.overlap_length("a", "b")).collect()] == [4, 0, 0]


def test_format_chunks(spark):
    rows = spark.createDataFrame([([("s", "t"), ("u", "v")],), ([],)], "x array<struct<source:string,text:string>>")
    assert [r[0] for r in rows.select(text.format_chunks(F.col("x"))).collect()] == ["【s】t\n\n【u】v", text.NO_CONTEXT]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    got = row.select(vectors.norm(F.col("a")).alias("n"), vectors.normalise(F.col("z")).alias("z"), vectors.cosine(F.col("a"), F.col("z")).alias("c"), vectors.from_bytes(vectors.to_bytes("a")).alias("b")).first()
    assert got["n"] == 5.0 and got["z"] == [0.0, 0.0] and got["c"] is None and got["b"] == [3.0, 4.0]
