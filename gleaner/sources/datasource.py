"""Result pages as a Spark data source: each page of a provider's search is a partition, fetched by an executor.

    spark.dataSource.register(ProviderSource)
    spark.read.format("gleaner_results").option("provider", json).option("fetch", "module:function").option("query", "rice").option("pages", 3).load()

provider: JSON with id, search_url, container, fields and, optionally, kind. fetch: an importable function from an
address and a form to a page's text.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from urllib.parse import quote_plus, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from gleaner.sources.extract import ParseError, Plan, extract

SCHEMA = "page int, row int, provider string, kind string, title string, url string, snippet string, extra map<string,string>"


class _Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.provider, self.query = json.loads(options["provider"]), options.get("query", "")
        self.fetch, self.pages = options["fetch"], int(options.get("pages", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Page(i + 1) for i in range(self.pages)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        p = self.provider
        url = p["search_url"].replace("{query}", quote_plus(self.query).replace("+", "%20")).replace("{page}", str(partition.number))
        module, name = self.fetch.split(":")
        try:
            rows, _, _ = extract(getattr(importlib.import_module(module), name)(url, {}), Plan.of({"container": p["container"]} | p["fields"]), url)
        except ParseError:
            return
        for i, row in enumerate(r for r in rows if r.get("title", "").strip()):
            extra = {k: v for k, v in row.items() if k not in ("title", "url", "snippet") and v.strip()}
            yield partition.number, i, p["id"], p.get("kind", "web"), row["title"], row.get("url") or url, row.get("snippet", ""), extra


class ProviderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gleaner_results"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


SEARCH = (
    "provider string, kind string, page int, row int, title string, url string, site string, format string, snippet string, direct_url string, "
    "extra map<string,string>, error string"
)


class _Asked(InputPartition):
    """Requests that one task makes, in order: (provider, page)."""

    def __init__(self, requests: list[tuple[dict, int]]) -> None:
        self.requests = requests


class SearchReader(DataSourceReader):
    """Asks only what the filters leave: providers by id and kind, pages, and, of providers that can be asked so, one site and one format."""

    def __init__(self, options: dict[str, str]) -> None:
        self.providers = json.loads(options["providers"])
        self.query, self.fetch, self.pages = options.get("query", ""), options["fetch"], range(1, int(options.get("pages", "1")) + 1)
        self.pace, self.site, self.format = float(options.get("pace", "0")), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, values = f.attribute[0], {EqualTo: lambda f: (f.value,), In: lambda f: f.value}.get(type(f), lambda f: None)(f)
            if values is not None and name == "provider":
                self.providers = [p for p in self.providers if p["id"] in values]
            elif values is not None and name == "kind":
                self.providers = [p for p in self.providers if p.get("kind", "web") in values]
            elif values is not None and name == "page":
                self.pages = [i for i in self.pages if i in values]
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name == "page":
                self.pages = [i for i in self.pages if i < f.value or (isinstance(f, LessThanOrEqual) and i == f.value)]
            elif not (isinstance(f, IsNotNull) and name in ("provider", "kind", "page")):  # these never are
                if isinstance(f, EqualTo) and name in ("site", "format"):
                    setattr(self, name, f.value)  # what comes back need not keep to it
                yield f

    def url(self, p: dict, page: int) -> str:
        text = self.query
        for name, word in (("site", "site"), ("format", "filetype")):
            if name in p.get("asks", ()) and (value := getattr(self, name)):
                text += f" {word}:{value.lower()}"
        return p["search_url"].replace("{query}", quote_plus(text).replace("+", "%20")).replace("{page}", str(page))

    def partitions(self) -> list[InputPartition]:
        """One for each provider and page; with a pace one for each host, whose requests wait for each other."""
        asked = [(p, i) for p in self.providers for i in (self.pages if "{page}" in p["search_url"] else list(self.pages)[:1])]
        if not self.pace:
            return [_Asked([x]) for x in asked] or [_Asked([])]
        hosts: dict[str, list[tuple[dict, int]]] = {}
        for p, i in asked:
            hosts.setdefault(urlsplit(p["search_url"]).netloc, []).append((p, i))
        return [_Asked(x) for x in hosts.values()] or [_Asked([])]

    def read(self, partition: _Asked) -> Iterator[tuple]:
        module, name = self.fetch.split(":")
        fetch = getattr(importlib.import_module(module), name)
        for n, (p, page) in enumerate(partition.requests):
            if n and self.pace:
                time.sleep(self.pace)
            url, kind = self.url(p, page), p.get("kind", "web")
            try:
                rows, _, _ = extract(fetch(url, {}), Plan.of({"container": p["container"]} | p["fields"]), url)
            except ParseError:
                continue
            except Exception as e:
                yield p["id"], kind, page, 0, None, url, None, None, None, None, {}, f"{type(e).__name__}: {e}"
                continue
            for i, row in enumerate(r for r in rows if r.get("title", "").strip()):
                at = row.get("url") or url
                extra = {k: v for k, v in row.items() if k not in ("title", "url", "snippet", "directUrl", "format") and v.strip()}
                yield p["id"], kind, page, i, row["title"], at, urlsplit(at).netloc, row.get("format") or None, row.get("snippet", ""), row.get("directUrl") or None, extra, None


class SearchSource(DataSource):
    """A search over several providers as a table; a provider that fails is a row with its error.

        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(SearchSource)
        spark.read.format("gleaner_search").options(providers=json, fetch="module:function", query="rice", pages=3).load().where("kind = 'document' and site = 'x.org'")

    providers: a JSON list of id, search_url, container, fields and, optionally, kind and asks (which of site and format
    its query takes as site: and filetype:). pace: seconds between requests to one host.
    """

    @classmethod
    def name(cls) -> str:
        return "gleaner_search"

    def schema(self) -> str:
        return SEARCH

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(dict(self.options))
