import pytest
from pyspark.sql import functions as F

from gleaner.operators import transform as tr
from gleaner.operators.dataset import Dataset, Field, Partial, dense_positions, infer_fields

FIELDS = [Field("name"), Field("address"), Field("phone", "phone"), Field("email", "email"), Field("website", "url")]
ROWS = [
    (0, "  Amina   Rahman ", "12 Lake  Road", "+880 1712-345678", " Amina@Example.COM ", "https://a.example/x/#top"),
    (1, "Karim", "9 Hill St", "call us", "not-an-email", "ftp://k.example/"),
    (2, "Amina Rahman", "12 Lake Road", "+8801712345678", "amina@example.com", "https://a.example/x"),
    (3, " ", "", None, " ", ""),
]


@pytest.fixture()
def contacts(spark):
    df = spark.createDataFrame(ROWS, "i long, name string, address string, phone string, email string, website string").repartition(3)
    return Dataset.of("c", "Contacts", df, "i", FIELDS, now=5)


def values(d, *names):
    return [tuple(r) for r in d.df.orderBy("_pos").select(*(names or d.names)).collect()]


def test_of(contacts):
    row = contacts.df.orderBy("_pos").first()
    assert row["_id"] == "c-1" and row["_raw"] == {} and row["_collected_at"] == 5
    assert values(contacts, "phone")[3] == ("",)
    with pytest.raises(ValueError):
        Field(" ")
    assert Field("x", "no such type").type == "text"


def test_standard_cleanup(contacts):
    clean, steps = tr.report(contacts, tr.standard_cleanup())
    got = values(clean)
    assert got[0] == ("Amina Rahman", "12 Lake Road", "+8801712345678", "amina@example.com", "https://a.example/x")
    assert got[1] == ("Karim", "9 Hill St", "call us", "not-an-email", "ftp://k.example/") and len(got) == 3
    rows = {r["id"]: r for r in steps.collect()}
    assert rows["remove_empty_rows"]["rows_removed"] == 1 and rows["normalize_whitespace"]["cells_changed"] == 5 and rows["normalize_phone"]["cells_changed"] == 1
    assert clean.df.where("_pos = 0").select(clean.raw_of("name"), clean.was_modified("name"), clean.was_modified("phone")).first()[:] == ("  Amina   Rahman ", True, True)
    assert clean.df.where("_pos = 1").select(clean.was_modified("name")).first()[0] is False


def test_history_keeps_the_first_value(contacts):
    d = tr.run(contacts, [tr.change_case("upper", ["name"]), tr.change_case("lower", ["name"])])
    assert values(d, "_raw")[1] == ({"name": "Karim"},)
    back = d.changed({"name": F.lit("Karim")})
    assert back.df.where("_pos = 1").select(back.was_modified("name")).first()[0] is False
    moved = d.rename_field("name", "who")
    assert moved.df.where("_pos = 1").select(moved.was_modified("who")).first()[0] is False  # the old value stays under the old name


def test_select_rename_search_filter(contacts):
    assert contacts.select_fields(["email", "none", "name"]).names == ["email", "name"]
    assert contacts.rename_field("none", "x") is contacts
    both = contacts.rename_field("address", "name")
    assert both.names == ["name", "phone", "email", "website"] and values(both, "name")[1] == ("9 Hill St",)
    assert contacts.search(" ") is contacts and contacts.search("AMINA").count() == 2 and contacts.search("lake road", "address").count() == 1
    assert contacts.search("%").count() == 0 and contacts.search("x", "none").count() == 0
    assert contacts.filter(F.col("name") == "Karim").count() == 1 and contacts.remove(["c-1", "c-9"]).count() == 3
    assert contacts.remove(contacts.df.where("_pos > 0").select("_id")).count() == 1 and contacts.remove_empty_rows().count() == 3
    assert contacts.rename("Other").name == "Other" and not contacts.is_partial


def test_sort(spark):
    rows = [(0, "10"), (1, "x"), (2, "9"), (3, "B"), (4, "b"), (5, "")]
    df = spark.createDataFrame(rows, "i long, v string")
    number, text = Dataset.of("n", "n", df, "i", [Field("v", "number")]), Dataset.of("t", "t", df, "i", [Field("v")])
    order = lambda d, desc: [r["_pos"] for r in d.sorted_by("v", desc).collect()]
    assert order(number, False) == [2, 0, 5, 3, 4, 1] and order(number, True) == [1, 4, 3, 5, 0, 2]
    assert order(text, False) == [5, 0, 2, 3, 4, 1] and order(text, True) == [1, 4, 3, 2, 0, 5]


def test_merge(spark, contacts):
    twice = contacts.merge(contacts, "Both")
    assert twice.count() == 8 and twice.name == "Both" and twice.source.kind == "merge"
    assert [r["_pos"] for r in twice.df.orderBy("_pos").collect()] == list(range(8))
    other = Dataset.of("o", "o", spark.createDataFrame([(0, "7", "z")], "i long, name string, extra string"), "i", [Field("name", "number"), Field("extra", "date")])
    both = contacts.merge(other)
    assert both.names == [*contacts.names, "extra"] and both.type_of("name") == "text" and both.type_of("extra") == "date"
    assert values(both, "name", "email", "extra")[4] == ("7", "", "z")


def test_counts(contacts):
    assert {r.field: r.missing for r in contacts.missing_counts().collect()} == {n: 1 for n in contacts.names}
    s = contacts.stats().first()
    assert (s.records, s["fields"], s.missing["phone"], s.empty_rows) == (4, 5, 1, 1)
    assert Dataset("x", "x", contacts.df, (), partial=Partial(5, 1)).is_partial and not Dataset("x", "x", contacts.df, (), partial=Partial(5, 0, 3)).is_partial


def test_merge_and_split_fields(contacts):
    d = tr.merge_fields(["name", "none", "address"], "both", " / ")(contacts)
    assert values(d, "both")[1] == ("Karim / 9 Hill St",) and values(d, "both")[3] == ("",) and "name" in d.names and values(d, "_raw")[0] == ({},)
    assert tr.merge_fields(["none"], "x")(contacts) is contacts
    gone = tr.merge_fields(["name", "address"], "name", drop_sources=True)(contacts)
    assert gone.names == ["phone", "email", "website"]
    s = tr.split_field("website", ["scheme", "host", "more"], "//")(contacts)
    assert values(s, "scheme", "host", "more")[1] == ("ftp:", "k.example/", "") and tr.split_field("none", ["a"])(contacts) is contacts
    assert values(tr.split_field("name", ["a", "b"], ".")(contacts), "a", "b")[1] == ("Karim", "")


def test_infer_and_positions(spark):
    rows = spark.createDataFrame([(2, {"b": "1", "c": "2"}), (1, {"a": "1", "b": "2"}), (3, None)], "i long, m map<string,string>")
    assert [f.name for f in infer_fields(rows, "m", "i")] == ["a", "b", "c"]
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(6)
    got = dense_positions(df, "k").collect()
    assert all(r["_pos"] == r["k"] for r in got) and len(got) == 1000


def test_paging(contacts):
    assert [r["_pos"] for r in contacts.page(1, 2).collect()] == [1, 2] and contacts.page(9, 2).count() == 0
    assert [r["_pos"] for r in contacts.page(0, 1, "amina", "name", True).collect()] == [2]
    for bad in ((-1, 1), (0, 0)):
        with pytest.raises(ValueError):
            contacts.page(*bad)
