import random

import pytest

from gleaner.operators import results as rs
from gleaner.plans import intent
from gleaner.sources.providers import HtmlProvider, Registry, SearchQuery, WebIndex, unwrap

CASES = [
    ("500 mp3 songs", "audio", "search", 500, ["mp3"]), ("research paper on rice as csv", "academic", "search", None, []), ("download https://x.org/a.pdf", "document", "download", None, ["pdf"]),
    ("https://x.org/list", "web", "scrape", None, []), ("ছবি ৫০০ টা", "image", "search", 500, []), ("মোবাইল নাম্বার ঢাকা", "contact", "search", None, []), ("kind:font anything", "font", "search", None, []),
    ("ubuntu torrent", "torrent", "search", None, ["torrent"]), ("python code repo", "code", "search", None, []), ("10.1038/nature12373", "academic", "search", None, []), ("a dozen cafes", "geo", "search", 12, []),
    ("kind:other weather", "web", "search", None, []), ("", "web", "search", None, []), ("weather tomorrow", "web", "search", None, []), ("9999999 images", "image", "search", None, []), ("email address list", "contact", "search", None, []),
]


def parsed(spark, *texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    return [r.asDict() for r in intent.parse(df, **how).withColumn("line", intent.describe()).withColumn("n", intent.limit()).orderBy("i").collect()]


def test_intents(spark):
    for (text, kind, action, count, formats), got in zip(CASES, parsed(spark, *[c[0] for c in CASES])):
        assert (got["kind"], got["action"], got["count"], got["formats"]) == (kind, action, count, formats), text


def test_intent_details(spark):
    a, b, c, d, e = parsed(spark, "find 20 pdf books of botany from www-lib.example.org as XLSX", "song video", "data", "Show  pictures, please", None)
    assert (a["site"], a["export_format"], a["subject"], a["kind"], a["n"]) == ("www-lib.example.org", "xlsx", "books botany", "document", 20)
    assert a["line"] == 'Search 20 documents & books (pdf) — "books botany" from www-lib.example.org → xlsx' and a["confidence"] == 0.95
    assert b["kind"] == "audio" and b["confidence"] == 0.5 < intent.LOW_CONFIDENCE and c["confidence"] == 0.85 and c["signals"] == ["dataset: word data"]
    assert d["subject"] == "pictures" and e["kind"] == "web" and e["confidence"] == 0.0 and e["n"] == 50
    own, = parsed(spark, "beats", hints={"beats": "audio"})
    assert own["kind"] == "audio" and own["signals"] == ["audio: hint beats"]


def test_refined():
    low, high = {"kind": "web", "confidence": 0.35}, {"kind": "web", "confidence": 0.9}
    better = lambda raw, i: {"kind": "audio", "confidence": 0.8}
    assert intent.refined(low, "x", better)["kind"] == "audio" and intent.refined(high, "x", better) is high and intent.refined(low, "x", None) is low
    for bad in ({"kind": "nope", "confidence": 0.9}, {"kind": "audio", "confidence": 0.35}, None):
        assert intent.refined(low, "x", lambda r, i, b=bad: b) is low
    assert intent.refined(low, "x", lambda r, i: 1 / 0) is low
    assert intent.first_object('so {"a": {"b": 1}} there') == '{"a": {"b": 1}}' and intent.first_object("none") is None and intent.first_object("{") is None


def result(pos, title="t", url="", **k):
    base = dict.fromkeys(("kind", "provider", "snippet", "direct_url", "magnet", "size_bytes", "mime_type", "format", "duration_sec", "published", "author", "license"))
    return base | {"title": title, "url": url, "extra": {}, "_pos": pos} | k


def frame(spark, *rows, also=""):
    return spark.createDataFrame(list(rows), rs.SCHEMA + also)


def test_drop_repeats_and_rank(spark):
    df = frame(spark, result(0, url="http://x/1"), result(1, url="http://X/1/#a", direct_url="d", title="got"), result(2, url="http://x/2"), result(3, url="http://x/1", direct_url="e"), result(4, magnet="m:1"), result(5, url=" ", magnet="M:1"))
    got = rs.drop_repeats(df).orderBy("_pos").collect()
    assert [(r["_pos"], r.title) for r in got] == [(0, "got"), (2, "t"), (4, "t")]
    df = frame(spark, result(0, "nothing"), result(1, "rice paper", kind="academic"), result(2, "x", format="PDF"), result(3, "y", direct_url="d"), result(4, "on rice", kind="academic"))
    order = [r["_pos"] for r in rs.rank(df, "academic", ["pdf"], "rice paper the", 4).collect()]
    assert order == [3, 2, 1, 4]
    assert [r["_pos"] for r in rs.by_meaning(frame(spark, result(0), result(1)), None).collect()] == [0, 1]
    e = frame(spark, result(0, embedding=[1.0, 0.0]), result(1, embedding=[0.0, 1.0]), also=", embedding array<float>")
    assert [r["_pos"] for r in rs.by_meaning(e, [0.0, 2.0]).collect()] == [1, 0] and [round(r.score, 3) for r in rs.scores(e, "t", [1.0, 0.0]).orderBy("_pos").collect()] == [1.0, 0.5]


def loop(rows, vectors):
    """The rule itself."""
    kept = []
    for r in rows:
        hit = None
        for k in kept:
            if vectors:
                same = sum(x * y for x, y in zip(r["e"], k["e"])) >= 0.86
            else:
                a, b = (set(w for w in x["title"].lower().split() if len(w) > 2) for x in (r, k["r"]))
                same = bool(a) and bool(b) and len(a & b) / len(a | b) >= 0.82
            if same:
                hit = k
                break
        if hit is None:
            kept.append({"r": r, "e": r.get("e"), "p": r["_pos"]})
            continue
        old = hit["r"]
        key = lambda x: (x["direct_url"] is not None, x["size_bytes"] or 0, len(x["title"]))
        if key(r) > key(old):
            hit["r"] = r
    return sorted((k["p"], k["r"]["title"]) for k in kept)


@pytest.mark.parametrize("vectors", [True, False])
def test_drop_same_meaning(spark, vectors):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = []
    for i in range(60):
        v = [rng.random() for _ in range(3)]
        n = sum(x * x for x in v) ** 0.5
        rows.append(result(i, " ".join(rng.sample(words, rng.randint(4, 6))), direct_url=rng.choice([None, None, "d"]), size_bytes=rng.choice([None, 5, 9])) | ({"e": [x / n for x in v]} if vectors else {}))
    df = frame(spark, *rows, also=", e array<double>" if vectors else "").repartition(4)
    got = sorted((r["_pos"], r.title) for r in rs.drop_same_meaning(df, (), "e" if vectors else None).collect())
    assert got == loop(rows, vectors)


PAGE = "<div class=result><a class=name href='/1'>One <b>x</b></a><a class=dl href='/1.zip'>get</a><i class=size>1.5 MB</i><i class=fmt>ZIP</i><i class=x>more</i></div><div class=result><a class=name href=''></a></div>"


def test_html_provider(spark):
    p = HtmlProvider("p", "P", ("software",), "https://p.example/s?q={query}&p={page}", ".result", {"title": ".name", "url": ".name@href", "directUrl": ".dl@href", "sizeText": ".size", "format": ".fmt", "rating": ".x"})
    asked = []
    r, = p.search(spark, SearchQuery("a b&c", page=2), lambda url, form: asked.append(url) or PAGE).collect()
    assert asked == ["https://p.example/s?q=a%20b%26c&p=2"]
    assert (r.title, r.url, r.direct_url, r.size_bytes, r.format, r.extra, r.kind, r.provider) == ("One x", "https://p.example/1", "https://p.example/1.zip", 1572864, "ZIP", {"rating": "more"}, "software", "p")


def hit(i):
    return f"<div class='result'><a class='result__a' href='//index.example/l/?uddg=https%3A%2F%2Fx.example%2F{i}.pdf&amp;rut=z'>Hit {i}</a><a class=result__snippet>about {i}</a></div>"


def index(total, per=10, broken=None):
    calls = []

    def fetch(url, form):
        calls.append(form)
        page = int(form.get("s", 0)) // 30
        if broken == page:
            raise OSError("down")
        return "".join(hit(i) for i in range(page * per, min(total, (page + 1) * per))) + "<div class=result><a class=result__a href='https://doubleclick.net/x'>ad</a></div>"

    return fetch, calls


def test_web_index(spark):
    w = WebIndex("https://index.example/html")
    for limit, total, want, calls in ((50, 95, 50, 5), (10, 95, 10, 1), (100, 95, 95, 11), (9999, 9999, 300, 30)):
        fetch, asked = index(total)
        assert (len(w.collect(SearchQuery("q", limit=limit), fetch)), len(asked)) == (want, calls)
    fetch, asked = index(95, broken=2)
    rows = w.search(spark, SearchQuery("q", limit=50, filters={"site": "s.example", "formats": "pdf,epub"}), fetch).orderBy("_pos").collect()
    assert len(rows) == 20 and rows[0].url == "https://x.example/0.pdf" and rows[0].format == "PDF" and rows[0].direct_url and rows[0].snippet == "about 0"
    assert asked[0] == {"q": "q site:s.example filetype:pdf"} and asked[1]["s"] == "30" and asked[1]["dc"] == "31"
    with pytest.raises(OSError):
        w.collect(SearchQuery("q"), index(5, broken=0)[0])
    assert unwrap("https://plain.example/") == "https://plain.example/"


def test_registry_and_search(spark):
    good = HtmlProvider("good", "Good", ("audio",), "https://g.example/?q={query}", ".result", {"title": ".name", "url": ".name@href"})
    bad = HtmlProvider("bad", "Bad", ("audio", "web"), "https://b.example/?q={query}", ".result", {"title": ".name"}, trust="official_api")
    r = Registry(bad, good)
    assert r.kinds() == ["audio", "web"] and [p.id for p in r.for_kind("audio")] == ["bad", "good"] and r.get("x") is None
    failed = []

    def fetch(url, form):
        if "b.example" in url:
            raise OSError("down")
        return PAGE

    plan, found = intent.search(spark, "5 jazz songs", r, fetch, on_error=lambda p, e: failed.append(p.id))
    assert [p.id for p in plan.providers] == ["good", "bad"] and plan.query.limit == 5 and failed == ["bad"] and [x.title for x in found.collect()] == ["One x"]
    assert intent.plan(spark, "news today", r).fallback == [bad] and intent.plan(spark, "songs", r, {"good"}, 7).query.limit == 7
    r.unregister("bad")
    assert r.all() == [good] and intent.plan(spark, "news", r).fallback == []
    assert r.search_all(spark, SearchQuery("x", frozenset(("audio",)), 1), fetch).count() == 1 and r.search_all(spark, SearchQuery("x", frozenset(("geo",))), fetch).count() == 0


def fetch_fake(url, form):
    page = int(url.rsplit("=", 1)[1])
    return "" if page == 3 else f"<div class=r><b>T{page}</b><a href='/x{page}'>l</a><i>e</i></div><div class=r></div>"


def test_data_source(spark):
    import json

    from gleaner.sources.datasource import ProviderSource

    spark.dataSource.register(ProviderSource)
    provider = {"id": "p", "search_url": "https://p.example/?q={query}&p={page}", "container": ".r", "fields": {"title": "b", "url": "a@href", "note": "i"}}
    df = spark.read.format("gleaner_results").option("provider", json.dumps(provider)).option("fetch", "tests.test_search:fetch_fake").option("query", "a b").option("pages", 3).load()
    assert [tuple(r) for r in df.orderBy("page").collect()] == [(i, 0, "p", "web", f"T{i}", f"https://p.example/x{i}", "", {"note": "e"}) for i in (1, 2)]


def fetch_recorded(url, form):
    if "down" in url:
        raise OSError("no answer")
    site = "a.org" if "site%3Aa.org" in url else "b.org"
    return "".join(f"<li><b>{url}</b><a href='https://{site}/{i}'>l</a><i>{'PDF' if i % 2 else 'TXT'}</i></li>" for i in range(4))


@pytest.fixture()
def pushdown(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_search_source_asks_what_filters_leave(spark, pushdown):
    import json

    from gleaner.sources.datasource import SearchSource

    spark.dataSource.register(SearchSource)
    make = lambda id, kind, **more: {"id": id, "kind": kind, "search_url": f"https://{id}.example/?q={{query}}&p={{page}}", "container": "li", "fields": {"title": "b", "url": "a@href", "format": "i"}} | more
    providers = [make("one", "web", asks=["site", "format"]), make("two", "document"), make("down", "document")]
    df = spark.read.format("gleaner_search").options(providers=json.dumps(providers), fetch="tests.test_search:fetch_recorded", query="rice", pages=3).load()
    assert df.rdd.getNumPartitions() == 9 and df.count() == 27  # a row for each page that failed
    assert {(r.provider, r.page, r.error, r.title) for r in df.where("error is not null").collect()} == {("down", i, "OSError: no answer", None) for i in (1, 2, 3)}
    some = df.where("provider in ('one', 'two') and page <= 2 and kind = 'web'")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 8
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()  # all of it is the source's
    sited = df.where("site = 'a.org' and format = 'PDF' and page = 1")
    rows = sited.collect()
    assert {r.url for r in rows} == {"https://a.org/1", "https://a.org/3"} and all("rice%20site%3Aa.org%20filetype%3Apdf" in r.title for r in rows)
    paced = spark.read.format("gleaner_search").options(providers=json.dumps(providers[:2]), fetch="tests.test_search:fetch_recorded", query="rice", pages=3, pace=0.05).load()
    assert paced.rdd.getNumPartitions() == 2 and paced.count() == 24


def test_suggested_selectors():
    from gleaner.sources.extract import suggested

    model = lambda html, fields: {"title": "h1", "price": ".none", "bad": "p[", "other": "p"}
    assert suggested("<h1>x</h1><p>y</p>", ["title", "price", "bad"], model) == {"title": "h1"}
    assert suggested("<h1>x</h1>", ["title"], lambda h, f: 1 / 0) == {}


def test_http_over_a_local_server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from gleaner.sources.providers import HttpError, http_bytes, http_fetch

    class Answers(BaseHTTPRequestHandler):
        def answer(self, status, body, **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.path == "/moved":
                self.answer(302, b"", Location="/page")
            elif self.path == "/page":
                self.answer(200, "pâge".encode() + b"\xff " + self.headers.get("X-Mine", "").encode())
            else:
                self.answer(404, b"gone")

        def do_POST(self):
            self.answer(200, self.rfile.read(int(self.headers["Content-Length"])))

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert http_fetch(f"{at}/moved", {}) == "pâge\ufffd " and http_bytes(f"{at}/page", headers={"X-Mine": "me"}).endswith(b" me")
        assert http_fetch(f"{at}/", {"q": "a b&c", "s": "30"}) == "q=a+b%26c&s=30"
        for path in ("/none", "/nothing"):
            with pytest.raises(HttpError):
                http_fetch(f"{at}{path}", {})
    finally:
        server.shutdown()
