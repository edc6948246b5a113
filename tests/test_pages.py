import pytest

from gleaner.sources import jobspec
from gleaner.sources.extract import ParseError, Plan, diagnose, explain, extract, extract_pages, parse_selector
from gleaner.sources.html import SelectorError, parse, select


def texts(html, selector):
    return [n.text() for n in select(parse(html), selector)]


def test_tree():
    assert texts("<p>a<p>b <b>c</p>d", "p") == ["a", "b c"]
    assert texts("<ul><li>1<li>2<ul><li>3</ul></ul>", "ul > li") == ["1", "2 3", "3"]
    assert texts("<table><tr><td>x<td>y<tr><td>z</table>", "tr") == ["x y", "z"]
    assert texts('<script>var t="</p><p>no";</script><p>yes', "p") == ["yes"]
    assert texts("<div>a<br>b <i>c</i>d<p>e</p>&amp;&copy;</div>", "div") == ["a b cd e &©"]
    assert parse("<a href='x' href='y'>").elements()[0].attrs == {"href": "x"} and parse("<br><img>").elements()[1].tag == "img"
    assert select(parse("<div><b>x</b>&lt;</div>"), "div")[0].inner() == "<b>x</b>&lt;" and texts("</div>a", "div") == []


HTML = """<div id=top class="A b"><p class=x>1</p><p>2</p><span>3</span><p data-k="v w">4</p><a href="/z.pdf">5</a></div><p>6</p>"""


@pytest.mark.parametrize(
    "selector, want",
    [
        ("p", "1246"), ("div p", "124"), ("div > p.x", "1"), (".a .x", "1"), ("#top > span", "3"), ("p + p", "2"), ("span ~ p", "4"), ("p:nth-of-type(2)", "2"),
        ("div p:nth-of-type(odd)", "14"), ("div > :nth-child(3)", "3"), (":nth-last-child(1)", "56"), ("p:first-child", "1"), ("a:last-child, span", "35"), ("[data-k]", "4"), ("[data-k~=w]", "4"), ("a[href$='.pdf']", "5"),
        ("[href^='/z']", "5"), ("[href*=pd]", "5"), ("div :not(p)", "35"), ("div:has(span) > a", "5"), ("p:contains(2)", "2"), ("div *:eq(0)", "1"), ("p:gt(1)", "4"), ("*.x", "1"),
        ("span:only-of-type", "3"), ("div > p:last-of-type", "4"), ("p:not(.x, [data-k])", "26"),
    ],
)
def test_selectors(selector, want):
    assert "".join(texts(HTML, selector)) == want


@pytest.mark.parametrize("bad", ["", "p >", "> > p", "p:unknown", "p[", "p:nth-child(x)", ", p", "p:not(a"])
def test_bad_selectors(bad):
    with pytest.raises(SelectorError):
        select(parse(HTML), bad)


@pytest.mark.parametrize("raw, want", [("a@href", ("a", "href")), ("a", ("a", "text")), ("@HREF", ("", "href")), ("a@", ("a", "text")), ("a[x='y@z']", ("a[x='y@z']", "text")), ("a[x='@']@src", ("a[x='@']", "src")), ("", ("", "text"))])
def test_parse_selector(raw, want):
    assert parse_selector(raw) == want


BERTHS = """<main><section class="berth" id="b-7"><p>Quay   North 7</p><data value="14.5">depth 14.5 m</data><time>3 March 2021</time><a rel=chart href="../charts/n7.pdf">chart</a></section>
<section class="berth"><p>Quay South 2</p><data>depth 6 m</data><time>2021.11.30</time><a rel=chart href="//maps.harbour.example/s2">chart</a></section><section class="berth"><hr></section></main>"""
JOB = """{"spec_version":1,"name":"Berths","source":{"url":"https://harbour.example/quays/list"},"extract":{"container":"section.berth","fields":[
 {"name":"quay","selector":"p"},{"name":"depth","selector":"data","type":"number"},{"name":"surveyed","selector":"time","type":"date"},{"name":"chart","selector":"a[rel=chart]@href","type":"url"}]}}"""
HERE = "https://harbour.example/quays/list"


def pages(spark, *html, url=HERE):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id long, url string, html string")


def run(spark, job, *html, url=HERE):
    spec = jobspec.parse(job)
    names = [f.name for f in spec.fields]
    return [tuple(r) for r in jobspec.run(spec, pages(spark, *html, url=url)).orderBy("page_id", "_row").select(*names).collect()]


def test_rows_of_a_container(spark):
    want = [("Quay North 7", "14.5", "2021-03-03", "https://harbour.example/charts/n7.pdf"), ("Quay South 2", "6", "2021-11-30", "https://maps.harbour.example/s2")]
    assert run(spark, JOB, BERTHS) == want


def test_required_fields_defaults_and_lists(spark):
    board = """<table><tr class=dep><td>06:10<td>Ferry <em>Aurora</em><td class=via>Isle <td class=via>Cape<td class=desk>+358 (0)9-555 01
      <tr class=dep><td>07:00<td>cancelled<td class=via>Isle<tr class=dep><td>21:45<td>Freight <em>Borealis</em><td class=desk>desk 12 ৩৪</table>"""
    job = """{"spec_version":1,"source":{"url":"u"},"extract":{"container":"tr.dep","fields":[{"name":"vessel","selector":"em","required":true},{"name":"leaves","selector":"td:nth-of-type(1)"},
      {"name":"via","selector":"td.via@textall","type":"list","default":"direct"},{"name":"desk","selector":".desk","type":"phone"}]}}"""
    assert run(spark, job, board) == [("Aurora", "06:10", "Isle | Cape", "+3580955501"), ("Borealis", "21:45", "direct", "1234")]
    assert jobspec.parse(job).name == "untitled"


def test_one_row_without_a_container(spark):
    html = "<article><h2>MV Aurora</h2><ul><li>Launched: spring of 1987<li>Tonnage 12,400 gross</ul><link rel=home href='/fleet/aurora'></article>"
    job = r"""{"spec_version":1,"source":{"url":"u"},"extract":{"fields":[{"name":"name","selector":"h2"},{"name":"launched","selector":"li:nth-of-type(1)","type":"number","regex":"(\\d{4})"},
      {"name":"tonnage","selector":"li:nth-of-type(2)","type":"number"},{"name":"home","selector":"link@href","type":"url"}]}}"""
    assert run(spark, job, html) == [("MV Aurora", "1987", "12400", "https://harbour.example/fleet/aurora")]


def test_no_results(spark):
    spec = jobspec.parse(JOB)
    with pytest.raises(jobspec.NoResults) as e:
        jobspec.run_or_raise(spec, pages(spark, "<p>nothing</p>", ""))
    assert e.value.exit_code == 66
    rows, containers, counts = extract("<p>nothing</p>", spec.plan())
    assert rows == [] and "0 found" in explain(spec.plan(), counts, containers, 14)
    with pytest.raises(ParseError):
        extract("", spec.plan())


def test_limit_empty_rows_base_and_diagnosis(spark):
    html = "<base href='https://b.example/d/'><p class=c></p><p class=c><a href=x>1</a></p><p class=c><a href=y>2</a></p>"
    plan = Plan.of({"container": ".c", "l": "a@href", "none": "b", "next": "a.more"}, limit=1)
    assert [f[0] for f in plan.fields] == ["l", "none"]
    assert extract(html, plan, HERE)[0] == [{"l": "https://b.example/d/x", "none": ""}]
    assert extract_pages(pages(spark, html, "", None), plan).count() == 1
    got = {r.field: tuple(r)[1:] for r in diagnose(pages(spark, html, html), Plan.of({"container": ".c", "l": "a@href", "none": "b"})).collect()}
    assert got == {"l": (4, 4, 6, False), "none": (0, 0, 6, True)}
    assert Plan.of({"a": "p"}, ["a", "b"]).fields == (("a", "p", "text"), ("b", "", ""))


@pytest.mark.parametrize("bad", ["[]", "{", '{"spec_version":2}', '{"spec_version":1}', '{"spec_version":1,"source":{"url":" "}}', '{"spec_version":1,"source":{"url":"u"},"extract":{"fields":[]}}',
                                 '{"spec_version":1,"source":{"url":"u"},"extract":{"fields":[{"name":"a"}]}}', '{"spec_version":1,"source":{"url":"u"}}'])
def test_bad_jobs(bad):
    with pytest.raises(jobspec.ConfigError):
        jobspec.parse(bad)


def test_job_round_trip(spark):
    spec = jobspec.parse(JOB.replace('"name":"Berths"', '"name":"Berths","limits":{"max_rows":7},"pagination":{"mode":"next_link","next_selector":"a.n"},"output":{"formats":["md"],"dedup_keys":["quay"]}'))
    assert jobspec.parse(spec.to_json()) == spec and spec.plan().limit == 7 and spec.pagination["mode"] == "next_link" and spec.dedup_keys == ("quay",)
    d = jobspec.to_dataset(spec, jobspec.run(spec, pages(spark, BERTHS)), "_row")
    assert d.type_of("depth") == "number" and d.count() == 2
    trap = jobspec.parse('{"spec_version":1,"source":{"url":"u"},"extract":{"fields":[{"name":"container","selector":".berth"},{"name":"t","selector":"p"}]}}')
    assert trap.plan().container == ".berth"


def test_extraction_in_sql(spark):
    import json

    from gleaner.sources import tablefunction

    tablefunction.register(spark)
    pages = [(1, "https://a.org/x/", "<ul><li><b>One</b><a href='1'>x</a></li><li><b>Two</b></li><li></li></ul>"), (2, None, "<li><b>Three</b><a href='/3'>x</a></li>"), (3, "https://a.org", ""), (None, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.createOrReplaceTempView("some_pages")
    selectors = {"container": "li", "title": "b", "link": "a@href"}
    got = spark.sql(f"select * from extract_html(table(some_pages), '{json.dumps(selectors)}', 'page_id, url')")
    want = extract_pages(df, Plan.of(selectors), keep=("page_id", "url"))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 3
    assert spark.sql("select title from extract_html(table(some_pages), '{\"title\": \"b\"}') where title > 'S'").collect()[0].title == "Three"
    for bad in ("extract_html(table(some_pages), '[]')", "extract_html(table(select 1 as x), '{}')", "extract_html(table(some_pages), '{\"t\": \"b\"}', 'none')"):
        with pytest.raises(Exception, match="the plan|the first argument|no such columns"):
            spark.sql(f"select * from {bad}").collect()
