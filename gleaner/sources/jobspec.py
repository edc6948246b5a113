"""Jobs as JSON: what page to read, which fields to take from it, and what to do with them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import coerce as co
from gleaner.operators.dataset import Dataset, Field, Source
from gleaner.sources.extract import Plan, extract_pages

VERSION = 1
PAGINATION = ("none", "next_link", "url_pattern", "load_more", "infinite_scroll")


class EngineError(Exception):
    """An error with the exit code that a command line would end with."""

    exit_code = 1


class ConfigError(EngineError):
    exit_code = 78


class FetchError(EngineError):
    exit_code = 68


class RobotsBlocked(EngineError):
    exit_code = 77


class RateLimited(EngineError):
    exit_code = 75


class NoResults(EngineError):
    exit_code = 66


@dataclass(frozen=True)
class FieldSpec:
    name: str
    selector: str
    type: str = "text"
    required: bool = False
    default: str | None = None
    regex: str | None = None
    trim: bool = True


@dataclass(frozen=True)
class JobSpec:
    name: str
    url: str
    fields: tuple[FieldSpec, ...]
    container: str | None = None
    description: str = ""
    render: str = "none"
    headers: dict[str, str] = field(default_factory=dict)
    pagination: dict = field(default_factory=lambda: {"mode": "none", "next_selector": None, "url_pattern": None, "start_page": 1, "max_pages": 10})
    limits: dict = field(default_factory=lambda: {"max_rows": 1000, "delay_ms": 1500, "concurrency": 3, "timeout_ms": 30_000, "retry_max": 3})
    policy: dict = field(default_factory=lambda: {"respect_robots": True, "user_agent": "gleaner"})
    formats: tuple[str, ...] = ("csv",)
    dedup_keys: tuple[str, ...] = ()

    def plan(self) -> Plan:
        """A field named container is the container where the job sets none."""
        selectors = {f.name: f.selector for f in self.fields}
        if self.container:
            selectors["container"] = self.container
        return Plan.of(selectors, [f.name for f in self.fields], self.limits["max_rows"])

    def to_json(self, indent: int | None = 2) -> str:
        """The whole job, so that parse() gives it back."""
        fields = []
        for f in self.fields:
            d = {"name": f.name, "selector": f.selector}
            d |= {k: v for k, v, usual in (("type", f.type, "text"), ("required", f.required, False), ("default", f.default, None), ("regex", f.regex, None), ("trim", f.trim, True)) if v != usual}
            fields.append(d)
        extract = ({"container": self.container} if self.container else {}) | {"fields": fields}
        source = {"url": self.url} | ({"render": self.render} if self.render != "none" else {}) | ({"headers": self.headers} if self.headers else {})
        out = {"spec_version": VERSION, "name": self.name} | ({"description": self.description} if self.description else {})
        out |= {"source": source, "extract": extract, "pagination": {k: v for k, v in self.pagination.items() if v is not None}, "limits": self.limits, "policy": self.policy}
        return json.dumps(out | {"output": {"formats": list(self.formats), "dedup_keys": list(self.dedup_keys)}}, indent=indent, ensure_ascii=False)


def parse(text: str) -> JobSpec:
    try:
        o = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"not JSON: {e}") from e
    if not isinstance(o, dict) or "spec_version" not in o:
        raise ConfigError("spec_version is missing")
    if o["spec_version"] != VERSION:
        raise ConfigError(f"spec_version {o['spec_version']} is not {VERSION}")
    source, extract = o.get("source"), o.get("extract")
    if not isinstance(source, dict):
        raise ConfigError("source is missing")
    if not str(source.get("url") or "").strip():
        raise ConfigError("source.url is missing")
    if not isinstance(extract, dict):
        raise ConfigError("extract is missing")
    if not extract.get("fields"):
        raise ConfigError("extract.fields is empty")
    fields = []
    for f in extract["fields"]:
        for need in ("name", "selector"):
            if not str(f.get(need) or "").strip():
                raise ConfigError(f"a field has no {need}: {f}")
        fields.append(FieldSpec(f["name"], f["selector"], co.type_of(f.get("type")), bool(f.get("required", False)), f.get("default"), f.get("regex"), bool(f.get("trim", True))))
    base = JobSpec("", "", ())
    page = base.pagination | {k: v for k, v in (o.get("pagination") or {}).items() if k in base.pagination}
    page["mode"] = str(page["mode"]).lower() if str(page["mode"]).lower() in PAGINATION else "none"
    output = o.get("output") or {}
    return JobSpec(
        o.get("name", "untitled"), source["url"], tuple(fields), (extract.get("container") or "").strip() and extract["container"] or None, o.get("description", ""),
        source.get("render", "none"), dict(source.get("headers") or {}), page, base.limits | (o.get("limits") or {}), base.policy | (o.get("policy") or {}),
        tuple(output.get("formats") or ("csv",)), tuple(output.get("dedup_keys") or ()),
    )


FIELDS = "place int, name string, selector string, type string, required boolean, regex string, `default` string"


def fields_of(jobs: DataFrame, column: str, keep: str) -> DataFrame:
    """The fields of each job that a column holds as JSON, after it has been written anew and read again: keep, and FIELDS; no rows for what is no job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, text in zip(pdf[keep], pdf[column], strict=True):
                try:
                    again = parse(parse(text).to_json())
                except (ConfigError, TypeError):
                    continue
                out += [(k, i, f.name, f.selector, f.type, f.required, f.regex, f.default) for i, f in enumerate(again.fields)]
            yield pd.DataFrame(out, columns=[keep, "place", "name", "selector", "type", "required", "regex", "default"])

    return jobs.select(keep, column).mapInPandas(run, f"`{keep}` {jobs.schema[keep].dataType.simpleString()}, {FIELDS}")


def run(spec: JobSpec, pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The job's rows from pages: extracted, coerced to their fields' types, without those that lack a required field. Lazy."""
    rows = extract_pages(pages, spec.plan(), url, html, keep)
    spark = pages.sparkSession
    cells = [co.coerce(F.col(f"`{f.name}`"), f.type, f.regex, f.trim, f.default, spark).alias(f.name) for f in spec.fields]
    rows = rows.select(*keep, "_row", *cells)
    for f in spec.fields:
        if f.required:
            rows = rows.where(F.col(f"`{f.name}`") != "")
    return rows


def run_or_raise(spec: JobSpec, pages: DataFrame, **how) -> DataFrame:
    """run(), which raises NoResults where there is no row at all."""
    rows = run(spec, pages, **how)
    if rows.isEmpty():
        raise NoResults(f"{spec.name}: no rows")
    return rows


def to_dataset(spec: JobSpec, rows: DataFrame, position, id: str = "job", now: int = 0) -> Dataset:
    fields = [Field(f.name, f.type, origin=f.selector, required=f.required) for f in spec.fields]
    return Dataset.of(id, spec.name, rows, position, fields, Source("job", id, "", spec.url), now)
