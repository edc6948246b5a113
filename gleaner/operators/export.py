"""Exports of datasets as text: each row is rendered to a line on the executors, byte for byte as its format wants it.

A format is a header, a line for each row, what stands between lines, and a footer. write_file has executors write a
file side by side, and Spark's text sink writes folders of parts; submit writes to a stream of the driver, from lines that
come in order, a partition at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions.files import join_files
from gleaner.functions.storage import scope, scratch
from gleaner.operators.dataset import Dataset

BOM = "\ufeff"


class ExportError(Exception):
    pass


@dataclass(frozen=True)
class Options:
    fields: tuple[str, ...] = ()
    record_ids: frozenset[str] = frozenset()
    header: bool = True
    bom: bool = True
    null: str = ""
    delimiter: str = ","
    pretty: bool = True
    metadata: bool = False
    table: str = "records"


@dataclass(frozen=True)
class Rendered:
    header: str
    lines: DataFrame  # _pos, line
    joint: str  # between lines
    footer: str
    end: str = ""  # the last character of every line, if it is known


@dataclass(frozen=True)
class Format:
    id: str
    label: str
    extension: str
    mime: str
    render: Callable[[Dataset, list[str], Options, int | None], Rendered]
    bom: bool = True
    needs_count: bool = False


def _cell(d: Dataset, name: str, o: Options) -> Column:
    """The field's value, or the null value where it is blank."""
    c = F.col(f"`{name}`")
    return F.when(tx.is_blank(c), F.lit(o.null)).otherwise(c) if o.null else F.when(tx.is_blank(c), F.lit("")).otherwise(c)


def _lines(d: Dataset, line: Column) -> DataFrame:
    return d.df.select("_pos", line.alias("line"))


def _joined(parts: list[Column], by: str) -> Column:
    return F.concat_ws(by, *parts)


# -- separated values --------------------------------------------------------------


def csv_cell(c: Column, delimiter: str) -> Column:
    """Quoted where it holds the delimiter, a quote or a line end, or starts as a formula would."""
    risky = c.rlike("[" + re.escape(delimiter) + '"\\n\\r]') | c.rlike(r"\A[=+\-@]")
    return F.when(risky, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _csv_text(v: str, delimiter: str) -> str:
    risky = any(x in v for x in (delimiter, '"', "\n", "\r")) or v[:1] in tuple("=+-@")
    return '"' + v.replace('"', '""') + '"' if risky else v


def _separated(tab: bool):
    def render(d: Dataset, fields: list[str], o: Options, n: int | None) -> Rendered:
        by = "\t" if tab else o.delimiter
        line = F.concat(_joined([csv_cell(_cell(d, f, o), by) for f in fields], by), F.lit("\r\n"))
        header = by.join(_csv_text(f, by) for f in fields) + "\r\n" if o.header else ""
        return Rendered(header, _lines(d, line), "", "", "\n")

    return render


# -- JSON ------------------------------------------------------------------------


def json_string(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for a, b in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    rare = out
    for code in range(32):
        if chr(code) not in "\n\r\t":
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))


def _json_text(s: str) -> str:
    out = s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return '"' + re.sub(r"[\x00-\x1f]", lambda m: f"\\u{ord(m[0]):04x}", out) + '"'


def json_number(c: Column) -> Column:
    """Whole numbers without a fraction, others as the JVM prints doubles; a string where it is no number."""
    d = c.try_cast("double")
    whole = d.try_cast("long")
    return F.when(d.isNull(), json_string(c)).when(F.coalesce(d == whole.cast("double"), F.lit(False)), whole.cast("string")).otherwise(d.cast("string"))


def _object(d: Dataset, fields: list[str], o: Options) -> Column:
    parts = []
    for f in fields:
        v, kind = _cell(d, f, o), d.type_of(f)
        if kind in ("number", "currency"):
            shown = json_number(v)
        elif kind == "boolean":
            shown = F.when(v.isin("true", "false"), v).otherwise(json_string(v))
        else:
            shown = json_string(v)
        parts.append(F.concat(F.lit(_json_text(f) + ":"), F.when(v == "", F.lit("null")).otherwise(shown)))
    return F.concat(F.lit("{"), _joined(parts, ","), F.lit("}"))


def _json(d: Dataset, fields: list[str], o: Options, n: int | None) -> Rendered:
    nl, pad = ("\n", "  ") if o.pretty else ("", "")
    head = "{" + nl
    if o.metadata:
        types = f",{nl}".join(f"{pad}{pad}{_json_text(f)}: {_json_text(d.type_of(f))}" for f in fields)
        head += f'{pad}"dataset": {_json_text(d.name)},{nl}{pad}"records": {n},{nl}{pad}"schema": {{{nl}{types}{nl}{pad}}},{nl}'
    return Rendered(f'{head}{pad}"data": [{nl}', _lines(d, F.concat(F.lit(pad * 2), _object(d, fields, o))), f",{nl}", f"{nl}{pad}]{nl}}}", "}")


def _ndjson(d: Dataset, fields: list[str], o: Options, n: int | None) -> Rendered:
    return Rendered("", _lines(d, F.concat(_object(d, fields, o), F.lit("\n"))), "", "", "\n")


# -- YAML, Markdown, HTML, SQL -----------------------------------------------------

# Characters and words that make a YAML value need quotes.
YAML_MARKS = ":#{}[],&*?|<>=!%@`\"'\n"
YAML_WORDS = ("true", "false", "null", "yes", "no", "~")


def yaml_value(c: Column) -> Column:
    quoted = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    needs = c.rlike("[" + re.escape(YAML_MARKS) + "]") | (tx.trim(c) != c) | F.lower(c).isin(*YAML_WORDS) | (c == "")
    return F.when(needs, F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(c)


def _yaml_text(v: str) -> str:
    if not v or any(x in v for x in YAML_MARKS) or v.strip() != v or v.lower() in YAML_WORDS:
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return v


def _yaml(d: Dataset, fields: list[str], o: Options, n: int | None) -> Rendered:
    parts = [F.concat(F.lit(("  - " if i == 0 else "    ") + f"{f}: "), yaml_value(_cell(d, f, o)), F.lit("\n")) for i, f in enumerate(fields)]
    head = f"dataset: {_yaml_text(d.name)}\nrecords: {n}\n" if o.metadata else ""
    return Rendered(head + "data:\n", _lines(d, F.concat(*parts) if parts else F.lit("  - {}\n")), "", "", "\n")


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def _markdown(d: Dataset, fields: list[str], o: Options, n: int | None) -> Rendered:
    esc = lambda v: v.replace("|", "\\|").replace("\n", "<br>")
    head = f"# {d.name}\n\n" + (f"{n} records · {len(fields)} fields\n\n" if o.metadata else "")
    head += "| " + " | ".join(map(esc, fields)) + " |\n|" + "|".join("---" for _ in fields) + "|\n"
    line = F.concat(F.lit("| "), _joined([markdown_cell(_cell(d, f, o)) for f in fields], " | "), F.lit(" |\n"))
    return Rendered(head, _lines(d, line), "", "", "\n")


def html_cell(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _html_text(v: str) -> str:
    return v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}th,td{border:1px solid #ccc;padding:4px 8px;text-align:left}.empty{background:#fee}"


def _html(d: Dataset, fields: list[str], o: Options, n: int | None) -> Rendered:
    name = _html_text(d.name)
    head = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{name}</title><style>{STYLE}</style></head><body>\n<h1>{name}</h1>\n<p>{n} records · {len(fields)} fields</p>\n'
    head += "<table><thead><tr>" + "".join(f"<th>{_html_text(f)}</th>" for f in fields) + "</tr></thead><tbody>\n"
    cells = [
        F.when(tx.is_blank(f"`{f}`"), F.lit(f'<td class="empty">{_html_text(o.null)}</td>')).otherwise(F.concat(F.lit("<td>"), html_cell(F.col(f"`{f}`")), F.lit("</td>")))
        for f in fields
    ]
    return Rendered(head, _lines(d, F.concat(F.lit("<tr>"), *cells, F.lit("</tr>\n"))), "", "</tbody></table></body></html>\n", "\n")


def sql_literal(c: Column, ftype: str) -> Column:
    text = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    if ftype in ("number", "currency"):
        text = F.coalesce(c.try_cast("double").cast("string"), text)
    return F.when(tx.is_blank(c), F.lit("NULL")).otherwise(text)


def _sql(d: Dataset, fields: list[str], o: Options, n: int | None) -> Rendered:
    name = lambda s: '"' + s.replace('"', '""') + '"'
    kind = lambda t: {"number": "REAL", "currency": "REAL", "boolean": "INTEGER"}.get(t, "TEXT")
    head = f"-- {d.name}\n-- {n} records\n\nCREATE TABLE IF NOT EXISTS {name(o.table)} (\n"
    head += ",\n".join(f"  {name(f)} {kind(d.type_of(f))}" for f in fields) + "\n);\n\n"
    into = f"INSERT INTO {name(o.table)} ({', '.join(map(name, fields))}) VALUES ("
    line = F.concat(F.lit(into), _joined([sql_literal(F.col(f"`{f}`"), d.type_of(f)) for f in fields], ", "), F.lit(");\n"))
    return Rendered(head, _lines(d, line), "", "", "\n")


FORMATS: dict[str, Format] = {}


def register(f: Format) -> None:
    """Adds a format, or replaces the one with its id."""
    FORMATS[f.id.lower()] = f


for _f in (
    Format("csv", "CSV", "csv", "text/csv", _separated(False)),
    Format("tsv", "TSV", "tsv", "text/tab-separated-values", _separated(True)),
    Format("json", "JSON", "json", "application/json", _json, bom=False),
    Format("ndjson", "NDJSON", "ndjson", "application/x-ndjson", _ndjson, bom=False),
    Format("yaml", "YAML", "yaml", "application/yaml", _yaml),
    Format("md", "Markdown", "md", "text/markdown", _markdown),
    Format("html", "HTML", "html", "text/html", _html, needs_count=True),
    Format("sql", "SQL", "sql", "application/sql", _sql, needs_count=True),
):
    register(_f)


def format_of(id: str) -> Format | None:
    return FORMATS.get(id.lower())


@dataclass(frozen=True)
class Validation:
    problems: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()

    @property
    def ok(self) -> bool:
        return not self.problems

    def summary(self) -> str:
        return "\n".join(self.problems or self.warnings) or "Nothing stands in the way."


@dataclass(frozen=True)
class Result:
    format: str
    bytes: int
    records: int
    fields: tuple[str, ...]
    filename: str


def filename(name: str, extension: str) -> str:
    safe = re.sub(r"(?:(?![._-])[\W_])+", "_", name.strip()).strip("_")
    return f"{(safe if safe.strip() else 'dataset')[:60]}.{extension}"


@dataclass(frozen=True)
class Request:
    dataset: Dataset
    format: str
    options: Options = field(default_factory=Options)
    filename: str | None = None

    def fields(self) -> list[str]:
        return [f for f in self.options.fields if f in self.dataset.names] if self.options.fields else self.dataset.names

    def selected(self) -> Dataset:
        ids = self.options.record_ids
        return self.dataset.filter(F.col("_id").isin(*sorted(ids))) if ids else self.dataset

    def validate(self) -> Validation:
        d, o, problems, warnings = self.dataset, self.options, [], []
        if format_of(self.format) is None:
            problems.append(f"There is no format {self.format!r}; there are {', '.join(FORMATS)}.")
        if d.df.isEmpty():
            problems.append(f"{d.name!r} has no records.")
        if not self.fields():
            problems.append("No field is left to write.")
        warnings += [f"{f!r} is no field and is left out." for f in o.fields if f not in d.names]
        if o.record_ids and self.selected().df.isEmpty():
            problems.append("None of the chosen records exists.")
        if d.is_partial:
            warnings.append(f"The dataset is partial: {d.partial.failed} pages failed, {d.partial.skipped} were skipped.")
        if self.filename and re.search(r'[/\\:*?"<>|]', self.filename):
            problems.append("The file name has characters that are not allowed.")
        return Validation(tuple(problems), tuple(warnings))

    def describe(self) -> str:
        f = format_of(self.format)
        return f"{self.selected().count()} records, {len(self.fields())} fields, as {f.label if f else self.format}"


def render(request: Request) -> Rendered:
    """What the request writes, without checks."""
    f, d = format_of(request.format), request.selected()
    n = d.count() if f.needs_count or request.options.metadata else None
    out = f.render(d, request.fields(), request.options, n)
    return replace(out, header=BOM + out.header) if request.options.bom and f.bom else out


def submit(request: Request, out: BinaryIO) -> Result:
    """Check, then write to out in the order of _pos; nothing is written where a check fails.

    A stream of the driver means that all lines pass through it, a partition at a time; large datasets are for write_file,
    write_parts and write_parquet, which executors write.
    """
    check = request.validate()
    if not check.ok:
        raise ExportError("; ".join(check.problems))
    f, r = format_of(request.format), render(request)
    size = out.write(r.header.encode()) or 0
    n = 0
    for row in r.lines.orderBy("_pos").select("line").toLocalIterator():
        size += out.write(((r.joint if n else "") + row["line"]).encode())
        n += 1
    size += out.write(r.footer.encode()) or 0
    return Result(f.id, size, n, tuple(request.fields()), request.filename or filename(request.dataset.name, f.extension))


def _end(request: Request, r: Rendered) -> str:
    """The character that every line ends with: known of the formats that are here from the start, else looked up."""
    if r.end:
        return r.end
    last = F.right("line", F.lit(1))
    found = r.lines.agg(F.min(last).alias("a"), F.max(last).alias("b"), F.min(F.length("line")).alias("n")).first()
    if not found["n"] or found["a"] != found["b"]:
        raise ExportError(f"lines of {request.format} do not all end alike: submit() writes them")
    return found["a"]


def write_file(request: Request, path: str) -> Result:
    """Check, then write one file at path, byte for byte as submit() would; nothing is written where a check fails.

    Executors write the sorted lines as parts, and put the parts together (functions/files.py); no line comes to the
    driver, and the file is there whole or not at all.
    """
    check = request.validate()
    if not check.ok:
        raise ExportError("; ".join(check.problems))
    f, r = format_of(request.format), render(request)
    spark, end, lines, seen = r.lines.sparkSession, _end(request, r), r.lines, Observation()
    if r.joint:  # before each line but the first
        first = lines.agg(F.min("_pos")).first()[0]
        lines = lines.select("_pos", F.when(F.col("_pos") == first, F.col("line")).otherwise(F.concat(F.lit(r.joint), "line")).alias("line"))
    # the text sink ends each line with a separator: here with the line's own last character
    value = F.substring("line", F.lit(1), F.length("line") - 1)
    with scope() as held:
        folder = scratch(spark, "export")
        ordered = lines.orderBy("_pos").observe(seen, F.count(F.lit(1)).alias("n")).select(value.alias("value"))
        ordered.write.option("lineSep", end).option("compression", "none").text(folder)
        size = join_files(spark, r.header.encode(), folder, r.footer.encode(), path)
        held.remove(spark)
    return Result(f.id, size, seen.get["n"], tuple(request.fields()), request.filename or filename(request.dataset.name, f.extension))


def write_parts(request: Request, path: str) -> None:
    """The lines alone as ordered part files, for line formats: executors write, the driver holds nothing."""
    r = render(request)
    if r.joint or r.footer:
        raise ExportError(f"{request.format} is no format of independent lines")
    end = "\r\n" if request.format.lower() in ("csv", "tsv") else "\n"
    line = F.substring("line", F.lit(1), F.length("line") - len(end)) if end else F.col("line")
    r.lines.orderBy("_pos").select(line.alias("value")).write.option("lineSep", end).text(path)


def write_parquet(d: Dataset, path: str) -> None:
    """The fields as Parquet."""
    d.values().write.parquet(path)
