import pytest
from pyspark.sql import functions as F

from gleaner.functions import coerce as co
from gleaner.functions import scalar as sc
from gleaner.functions import text as tx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "value, kind, how, want",
    [
        ("৳১,২৫০.০০", "currency", {}, "1250.00"), ("1,250 300.5", "number", {}, "1250300.5"), ("call 5 people", "number", {}, "5"), ("none", "number", {}, ""),
        ("-3.5 °C", "number", {}, "-3.5"), (" +880 1712-345678 ", "phone", {}, "+8801712345678"), ("01812 345 679", "phone", {}, "01812345679"),
        ("  A@B.CoM ", "email", {}, "a@b.com"), ("Write to X@Y.org now", "email", {}, "x@y.org"), ("no address", "email", {}, "no address"),
        ("05/03/2024", "date", {}, "2024-03-05"), ("15 January 2024", "date", {}, "2024-01-15"), ("5 Sep 2024", "date", {}, "2024-09-05"),
        ("31/02/2024", "date", {}, "2024-02-29"), ("2023-02-31", "date", {}, "2023-02-28"), ("5/3/2024", "date", {}, "2024-03-05"), ("12/25/2024", "date", {}, "2024-12-25"),
        ("5 Sept 2024", "date", {}, "5 Sept 2024"), ("15 january 2024", "date", {}, "15 january 2024"), ("March 4, 2021", "date", {}, "2021-03-04"),
        ("2021.03.04", "date", {}, "2021-03-04"), ("on 2024-13-45 or so", "date", {}, "2024-13-45"), ("31/04/2024 10:00", "date", {}, "31/04/2024 10:00"), ("", "date", {}, ""),
        ("Out of  stock", "boolean", {}, "false"), ("", "boolean", {}, "false"), ("maybe", "boolean", {}, "true"), ("না", "boolean", {}, "false"),
        ("Founded 1999", "number", {"regex": r"(\d{4})"}, "1999"), ("Founded 1999", "text", {"regex": r"\d{2}"}, "19"), ("abc", "text", {"regex": "(x)"}, ""),
        ("abc", "text", {"regex": "(["}, "abc"), ("", "text", {"default": "n/a"}, "n/a"), ("  a   b\n\tc ", "text", {}, "a b c"), (None, "text", {"default": "d"}, "d"),
    ],
)
def test_coerce(spark, value, kind, how, want):
    assert one(spark, value, lambda c: co.coerce(c, kind, spark=spark, **how)) == want


def test_blanks(spark):
    assert one(spark, "   a b \x0b\n", tx.trim) == "a b"
    assert one(spark, "a \u0085", tx.trim) == "a \u0085"
    assert one(spark, "  \t\x1c", tx.is_blank) is True and one(spark, "​", tx.is_blank) is False and one(spark, "", tx.is_blank) is True
    assert one(spark, " a   b ", tx.collapse) == "a   b"


@pytest.mark.parametrize("text, want", [("1.4 GB", 1503238553), ("2 GiB", 2147483648), ("1,229 KB", 1258496), ("unknown", None), ("9.4 MB", 9856614), ("12 b", 12), (".. KB", None)])
def test_sizes(spark, text, want):
    assert one(spark, text, sc.parse_size) == want


def test_human_sizes(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1024,), (9856614,), (1024**4 * 3000,)], "n long").select(sc.human_size("n")).collect()
    assert [r[0] for r in rows] == ["0 B", "1023 B", "1.0 KB", "9.4 MB", "3000.0 TB"]


def test_addresses(spark):
    assert one(spark, " HTTP://X/a/#b ", sc.url_key) == "http://x/a"
    assert one(spark, "http://X/a//#b", sc.url_key) == "http://x/a/" and one(spark, "http://X/a//#b", sc.page_key) == "http://x/a"
    assert one(spark, " http://X/a//#b", sc.clean_url) == "http://X/a" and one(spark, " HTTP://X/", sc.clean_url) == " HTTP://X/"
    assert one(spark, "/l/?uddg=https%3A%2F%2Fx%2Fa+b%3Fc&rut=1", sc.unwrap_redirect) == "https://x/a b?c"
    assert one(spark, "/l/?uddg=%zz", sc.unwrap_redirect) == "/l/?uddg=%zz"
    assert one(spark, "a b+ü", sc.url_encode) == "a%20b%2B%C3%BC"
    assert one(spark, "http://x/A.PDF?x", sc.extension) == "pdf" and one(spark, "http://x/a", sc.extension) == ""
    assert one(spark, "hELLO wORLD a\tb x-y", sc.title_case) == "Hello World A\tb X-y"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [0.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = df.select(sc.cosine("a", "b").alias("c"), sc.normalize("a").alias("n")).collect()
    assert [round(r.c, 6) for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [round(x, 6) for x in got[0].n] == [0.6, 0.8] and got[4].n == [0.0]


def test_similarities(spark):
    df = spark.createDataFrame([("mohammed rahman", "mohammad rahman"), ("abc", "xyz"), ("", "a")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(sc.trigram_similarity("a", "b")).collect()] == [0.6842, 0.0, 0.0]
    df = spark.createDataFrame([("The Blue Song official", "blue song (HD)"), ("a b", "a b"), ("one two", "two three")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(sc.token_similarity("a", "b")).collect()] == [1.0, 0.0, 0.3333]


def test_maps_as_json(spark):
    df = spark.createDataFrame([({"a": 'q"', "b": ""},), (None,)], "m map<string,string>")
    got = df.select(sc.encode_map("m").alias("j")).select("j", sc.decode_map("j").alias("m")).collect()
    assert got[0].m == {"a": 'q"', "b": ""} and got[1].j == "{}" and got[1].m == {}
    assert spark.createDataFrame([("no json",)], "j string").select(sc.decode_map("j")).first()[0] == {}


def test_scratch_tables_are_swept(spark):
    from gleaner.functions import storage

    storage.sweep(spark)
    df = storage.written(spark.range(5), "t")
    assert df.count() == 5 and storage.sweep(spark) == 1 and storage.sweep(spark) == 0
