"""Rows from web pages by CSS selectors: the scan that runs in Python workers, and what it needs from the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.html import Node, parse, select

# Selector names that are no fields, and attributes that hold addresses.
RESERVED = frozenset(("container", "pagination", "next", "next_selector", "load_more", "load_more_selector", "infinite_scroll"))
ADDRESSES = frozenset(("href", "src", "data-src", "srcset", "action", "poster"))
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


class ParseError(ValueError):
    """A document that holds nothing."""


def parse_selector(raw: str) -> tuple[str, str]:
    """(selector, what to take): split at the last @ outside square brackets; text where nothing follows."""
    s, depth = raw.strip(), 0
    for i in range(len(s) - 1, -1, -1):
        depth += {"]": 1, "[": -1}.get(s[i], 0)
        if s[i] == "@" and depth == 0:
            return s[:i].strip(), s[i + 1 :].strip().lower() or "text"
    return s, "text"


def collapse(s: str) -> str:
    return _BLANKS.sub(" ", s).strip()


@dataclass(frozen=True)
class Plan:
    """What to take from a page: fields in order as (name, selector, take); container: a row for each match, else one for the page."""

    fields: tuple[tuple[str, str, str], ...]
    container: str | None = None
    limit: int | None = None
    keep_empty: bool = False

    @staticmethod
    def of(selectors: dict[str, str], fields: list[str] | None = None, limit: int | None = None, keep_empty: bool = False) -> Plan:
        container = (selectors.get("container") or "").strip() or None
        named = {k: v for k, v in selectors.items() if k not in RESERVED and v.strip()}
        if fields is not None:
            named = {f: named.get(f, "") for f in fields}
        return Plan(tuple((k, *parse_selector(v)) if v else (k, "", "") for k, v in named.items()), container, limit, keep_empty)


def _value(found: list[Node], take: str, base: str) -> str:
    if not found:
        return ""
    first = found[0]
    if take == "text":
        return collapse(first.text())
    if take == "html":
        return first.inner()
    if take == "textall":
        return " | ".join(t for n in found if (t := collapse(n.text())))
    raw = first.attrs.get(take, "")
    if take in ADDRESSES and base and raw:
        try:
            joined = urljoin(base, raw.strip())
            return joined if urlsplit(joined).scheme else raw.strip()
        except ValueError:
            return raw.strip()
    return raw.strip()


def extract(html: str, plan: Plan, url: str = "") -> tuple[list[dict[str, str]], int, dict[str, tuple[int, int]]]:
    """(rows, containers, {field: (elements matched, rows with a value)}) of a page. Rows that are blank in every field do not count against the limit."""
    if not html:
        raise ParseError("an empty document")
    doc = parse(html)
    base = url
    if url and (tags := select(doc, "base")) and tags[0].attrs.get("href"):
        base = urljoin(url, tags[0].attrs["href"])
    nodes = select(doc, plan.container) if plan.container else [doc]
    rows, matched, filled = [], dict.fromkeys((f[0] for f in plan.fields), 0), dict.fromkeys((f[0] for f in plan.fields), 0)
    for node in nodes:
        if plan.limit is not None and len(rows) >= plan.limit:
            break
        row = {}
        for name, selector, take in plan.fields:
            if not take:
                row[name] = ""
                continue
            found = select(node, selector) if selector else [node]
            matched[name] += len(found)
            row[name] = _value(found, take, base)
            filled[name] += bool(row[name].strip())
        if plan.keep_empty or any(v.strip() for v in row.values()):
            rows.append(row)
    return rows, len(nodes) if plan.container else 0, {n: (matched[n], filled[n]) for n in matched}


def _scan(plan: Plan, url: str, html: str, keep: list[str], what: str):
    names = [f[0] for f in plan.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, urls = batch.column("_html"), batch.column("_url")
            at, columns = [], [[] for _ in range(len(names) + 1 if what == "rows" else 4)]
            for i in range(batch.num_rows):
                try:
                    rows, containers, counts = extract(pages[i].as_py() or "", plan, urls[i].as_py() or "")
                except ParseError:
                    continue
                found = [(j, *(r[n] for n in names)) for j, r in enumerate(rows)] if what == "rows" else [(n, *c, containers) for n, c in counts.items()]
                at += [i] * len(found)
                for row in found:
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            kinds = [pa.int32(), *[pa.string()] * len(names)] if what == "rows" else [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            out = ["_row", *(f"_f{i}" for i in range(len(names)))] if what == "rows" else ["field", "matched", "filled", "containers"]
            taken = batch.select(keep).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keep, *out])

    return run


def _pages(pages: DataFrame, url: str, html: str, keep: list[str]) -> DataFrame:
    return pages.select(*keep, F.col(url).cast("string").alias("_url"), F.col(html).cast("string").alias("_html"))


def extract_pages(pages: DataFrame, plan: Plan, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each container of each page: the kept columns, _row (its number on the page, from 0), and the plan's fields. Pages that are empty give none."""
    keep_ = list(keep)
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep_), "_row int", *(f"_f{i} string" for i in range(len(plan.fields)))])
    out = _pages(pages, url, html, keep_).mapInArrow(_scan(plan, url, html, keep_, "rows"), schema)
    return out.select(*keep_, "_row", *[F.col(f"_f{i}").alias(f[0]) for i, f in enumerate(plan.fields)])


def diagnose(pages: DataFrame, plan: Plan, url: str = "url", html: str = "html") -> DataFrame:
    """For each field over all pages: field, matched (elements), filled (rows with a value), containers, dead (containers there, but never a value)."""
    counts = _pages(pages, url, html, []).mapInArrow(_scan(plan, url, html, [], "counts"), "field string, matched long, filled long, containers long")
    sums = counts.groupBy("field").agg(*[F.sum(c).alias(c) for c in ("matched", "filled", "containers")])
    return sums.withColumn("dead", (F.col("filled") == 0) & (F.col("containers") > 0))


def explain(plan: Plan, counts: dict[str, tuple[int, int]], containers: int, size: int, url: str = "") -> str:
    """A page's counts in words."""
    lines = [f"Extraction of {size} characters{f' from {url}' if url else ''}:"]
    if plan.container:
        lines.append(f"  container {plan.container!r}: {containers} found")
        if not containers:
            lines.append("    none: the page may be built differently, or by scripts")
    else:
        lines.append("  no container: the page is one row")
    for name, selector, take in plan.fields:
        m, n = counts.get(name, (0, 0))
        lines.append(f"  {name} ({selector}@{take}): {m} elements, {n} values{'' if n else ', EMPTY'}")
    return "\n".join(lines)


def suggested(html: str, fields: list[str], model: Callable[[str, list[str]], dict[str, str]], url: str = "") -> dict[str, str]:
    """Selectors that a model suggests for the fields of a page, those alone that give a value on that page; nothing if the model fails."""
    try:
        found = model(html, fields)
    except Exception:
        return {}
    kept: dict[str, str] = {}
    container = {"container": found["container"]} if isinstance(found.get("container"), str) else {}
    for name, selector in found.items():
        if name in fields and isinstance(selector, str) and selector.strip():
            try:
                rows, _, _ = extract(html, Plan.of(container | {name: selector}), url)
            except ValueError:
                continue
            if rows:
                kept[name] = selector
    return kept | (container if kept else {})


def suggestions(pages: DataFrame, fields: list[str], model: Callable[[str, list[str]], dict[str, str]], keep: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """suggested() for each page, on the executors: keep, field, selector."""

    def run(frames):
        for pdf in frames:
            out = [(k, f, s) for k, u, h in zip(pdf[keep], pdf["_url"], pdf["_html"], strict=True) for f, s in suggested(h, fields, model, u).items()]
            yield pd.DataFrame(out, columns=[keep, "field", "selector"])

    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((url, "_url"), (html, "_html"))]
    return pages.select(keep, *cells).mapInPandas(run, f"`{keep}` {pages.schema[keep].dataType.simpleString()}, field string, selector string")
