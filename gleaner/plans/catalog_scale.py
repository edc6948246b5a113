"""Queries of what the engine does at size: versions, deep pages and the trigram index of stored datasets."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gleaner.functions.storage import scratch
from gleaner.operators import export, results
from gleaner.operators.dataset import Dataset, Field
from gleaner.plans import catalog  # noqa: F401  whose SQL is used again
from gleaner.plans import store as st
from gleaner.plans.registry import _SQL, _results, _suppliers, closed, query, table
from gleaner.sources import tablefunction
from gleaner.sources.datasource import SearchSource

#: Rows of a stored file in these queries, so that the test tables have several.
FILE_ROWS = 2_000


def _store(spark) -> st.Store:
    return st.Store(spark, scratch(spark, "store"), FILE_ROWS)


def _customers(spark, sf_dir) -> Dataset:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return Dataset.of("customers", "Customers", df, "c_custkey", [Field("c_custkey", "number"), Field("c_name"), Field("c_mktsegment"), Field("c_acctbal", "currency")])


def _orders(spark, sf_dir) -> Dataset:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return Dataset.of("orders", "Orders", df, "o_orderkey", [Field("o_orderkey", "number"), Field("o_orderstatus"), Field("o_totalprice", "currency")])


# -- the store: versions, pages, search -------------------------------------------------


@query("""select 1 as version, cast(c_custkey as varchar) as c_custkey, c_name, (select count(*) from customer) as noted from customer
    union all select 2, cast(c_custkey as varchar), c_name, (select count(*) from customer where c_custkey % 7 <> 0) from customer where c_custkey % 7 <> 0
    union all select 3, cast(c_custkey as varchar), c_name, (select count(*) from customer where c_custkey % 7 <> 0 and c_acctbal > 0) from customer where c_custkey % 7 <> 0 and c_acctbal > 0""")
def q_store_versions(spark, sf_dir):
    """Three versions of a dataset, each loaded before the next commit and read after the last: removed rows, then a filter saved; a writer that comes late is refused."""
    s = _store(spark)
    s.save(_customers(spark, sf_dir))
    first = s.load("customers")
    s.delete_records("customers", first.df.where(F.col("_pos") % 7 == 0).select("_id"))
    second = s.load("customers")
    s.save(second.filter(F.col("c_acctbal").cast("double") > 0))
    third, out = s.load("customers"), None
    for late in (first, second):
        try:
            s.save(late)
        except st.Conflict:
            continue
        raise AssertionError("a version that was not seen was replaced")
    for d in (first, second, third):
        noted = s.files.get(s._log("customers", d.version))["records"]
        rows = d.df.select(F.lit(d.version).alias("version"), "c_custkey", "c_name", F.lit(noted).cast("long").alias("noted"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""with o as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as place, count(*) over () as n from orders where o_orderkey % 5 <> 0)
    select cast(o_orderkey as varchar) as o_orderkey, o_totalprice, n as total, true as few_files from o where place >= floor(n * 9 / 10) and place < floor(n * 9 / 10) + 40""")
def q_store_deep_page(spark, sf_dir):
    """Forty records from nine tenths of a stored table on, a fifth of whose rows are removed: one or two of its files are read."""
    s = _store(spark)
    d = _orders(spark, sf_dir)
    s.save(d)
    s.delete_records("orders", d.df.where(F.col("_pos") % 5 == 0).select("_id"))
    total = s.summary("orders").records
    page = s.page("orders", total * 9 // 10, 40)
    read = sum("/files-" in f for f in page.items.inputFiles())
    return page.items.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.lit(page.total).cast("long").alias("total"), F.lit(read in (1, 2)).alias("few_files"))


@query("""select 'key' as search, cast(o_orderkey as varchar) as o_orderkey, o_orderkey as place from orders
        where contains(cast(o_orderkey as varchar), (select cast(max(o_orderkey) as varchar) from orders)) or contains(cast(o_totalprice as varchar), (select cast(max(o_orderkey) as varchar) from orders))
    union all select 'state', cast(o_orderkey as varchar), o_orderkey from orders where contains(lower(o_orderstatus), 'f')
    union all select 'across', cast(o_orderkey as varchar), o_orderkey from orders where (cast(o_orderkey as varchar) || ' ' || lower(o_orderstatus) || ' ' || cast(o_totalprice as varchar)) like '%7 f 1%'""")
def q_store_search_index(spark, sf_dir):
    """Searches of a stored table by its trigram index: the largest key, a letter (too short for the index), and a pattern over cells."""
    s = _store(spark)
    d = _orders(spark, sf_dir)
    s.save(d)
    s.index("orders")
    key = str(d.df.agg(F.max("_pos")).first()[0])
    out = None
    for name, found in (("key", s.search("orders", key)), ("state", s.search("orders", "F")), ("across", s.search_blob("orders", "7 F 1"))):
        rows = found.df.select(F.lit(name).alias("search"), "o_orderkey", F.col("_pos").alias("place"))
        out = rows if out is None else out.unionByName(rows)
    return out


# -- results of one meaning ---------------------------------------------------------------


def same_meaning_sql(threshold: float, list_: str, title: str, size: str) -> str:
    """SQL of the rule itself, over embeddings: each result of a list, in order, against every place kept before it."""
    better = "struct_pack(s := t.size, l := length(t.title)) > struct_pack(s := k.s, l := k.l)"
    return f"""with recursive e as (select vec_id, {list_} as list, {title} as title, {size} as size, cast(embedding as double[]) as e from embeddings),
    t as (select *, row_number() over (partition by list order by vec_id) as i, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from e),
    r(list, i, kept) as (
        select distinct list, cast(0 as bigint), cast([] as struct(p bigint, b bigint, t varchar, s bigint, l bigint, u double[])[]) from t
        union all
        select r.list, t.i, case when hit.p is null then list_append(kept, struct_pack(p := t.vec_id, b := t.vec_id, t := t.title, s := cast(t.size as bigint), l := length(t.title), u := t.u))
            else list_transform(kept, lambda k: if(k.p = hit.p and {better}, struct_pack(p := k.p, b := t.vec_id, t := t.title, s := cast(t.size as bigint), l := length(t.title), u := k.u), k)) end
        from r join t on t.list = r.list and t.i = r.i + 1, lateral (select min(p) as p from (select unnest(kept, recursive := true)) where list_dot_product(u, t.u) >= {threshold}) hit),
    f as (select list, unnest(kept) as k from r join (select list as l, max(i) as m from r group by list) on list = l and i = m) """


_SQL["q_semantic_dedup"] = same_meaning_sql(0.86, "label", "concat('vector ', cast(vec_id as varchar))", "0") + "select list as label, k.p as vec_id, k.t as title from f"


@query(same_meaning_sql(0.2, "label", "concat('vector ', cast(vec_id as varchar))", "vec_id % 5") + "select list as label, k.p as place, k.b as vec_id, k.t as title from f")
def q_meaning_lists(spark, sf_dir):
    """Lists of results, one a label, at a loose threshold: of two alike the larger stays, then the one with the longer title, at the place of the first."""
    e = table(spark, sf_dir, "embeddings").withColumn("_pos", F.col("vec_id"))
    title = F.concat(F.lit("vector "), F.col("vec_id").cast("string"))
    r = _results(e, {"title": title, "size_bytes": F.col("vec_id") % 5}, ["label", "vec_id", "embedding"])
    return results.drop_same_meaning(r, ("label",), "embedding", 0.2).select("label", F.col("_pos").alias("place"), "vec_id", "title")


@query(same_meaning_sql(0.3, "0", "'a'", "vec_id % 7") + "select k.p as place, k.b as vec_id from f")
def q_meaning_whole(spark, sf_dir):
    """All results as one list, longer than a task may hold here: by blocks of places."""
    e = table(spark, sf_dir, "embeddings").withColumn("_pos", F.col("vec_id"))
    r = _results(e, {"title": F.lit("a"), "size_bytes": F.col("vec_id") % 7}, ["vec_id", "embedding"])
    return results.drop_same_meaning(r, (), "embedding", 0.3, most=100).select(F.col("_pos").alias("place"), "vec_id")


# -- whole files by executors --------------------------------------------------------------


@query(_SQL["q_export_files"])
def q_export_written(spark, sf_dir):
    """Whole files of all formats, put together by executors, and read again."""
    folder, told, out = scratch(spark, "files"), [], None
    for kind in ("csv", "tsv", "json", "ndjson", "yaml", "md", "html", "sql"):
        r = export.write_file(export.Request(_suppliers(spark, sf_dir), kind), f"{folder}/{kind}")
        told.append((r.format, r.bytes, r.records, r.filename))
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("format"), F.decode("content", "UTF-8").alias("body"))
    return files.join(spark.createDataFrame(told, "format string, bytes long, records long, filename string"), "format")


# -- a search as a table -------------------------------------------------------------------


def nation_page(url: str, form: dict[str, str]) -> str:
    """A fetch that executors make: a page of two nations of a region, from the table that the address names; one region doesn't answer."""
    import pyarrow.parquet as pq

    path, _, asked = url.partition("?")
    region, _, page = (x.split("=")[1] for x in asked.split("&"))
    if region == "4":
        raise OSError("no answer")
    rows = sorted((r["n_nationkey"], r["n_name"]) for r in pq.read_table(path).to_pylist() if str(r["n_regionkey"]) == region)
    some = rows[2 * int(page) - 2 : 2 * int(page)]
    return "<ul>" + "".join(f'<li><b>{name}</b><a href="https://n{k % 2}.example/{k}">x</a><i>{"PDF" if k % 3 == 0 else ""}</i></li>' for k, name in some) + "</ul>"


@query("""with n as (select *, (row_number() over (partition by n_regionkey order by n_nationkey) - 1) // 2 + 1 as page from nation)
    select concat('region-', cast(n_regionkey as varchar)) as provider, page, n_name as title, concat('https://n', cast(n_nationkey % 2 as varchar), '.example/', cast(n_nationkey as varchar)) as url,
        case when n_nationkey % 3 = 0 then 'PDF' end as format, null as error from n where n_regionkey in (0, 2) and page <= 2 and n_nationkey % 2 = 1
    union all select 'region-4', page, null, null, null, 'OSError: no answer' from (select unnest([1, 2]) as page)""")
def q_search_source(spark, sf_dir):
    """A source for each region, asked by executors, a task a page: filters on kind and page leave requests out, the one on the site is checked behind; who does not answer is a row."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
    regions = sorted(r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").collect())  # five rows
    providers = [
        {"id": f"region-{r}", "kind": "document" if r % 2 == 0 else "audio", "search_url": f"{sf_dir}/nation.parquet?region={r}&q={{query}}&page={{page}}", "container": "li", "fields": {"title": "b", "url": "a@href", "format": "i"}}
        for r in regions
    ]
    found = spark.read.format("gleaner_search").options(providers=json.dumps(providers), fetch="gleaner.plans.catalog_scale:nation_page", query="all", pages=3).load()
    found = found.where("kind = 'document' and page <= 2 and (site = 'n1.example' or error is not null)")
    return found.select("provider", "page", "title", F.when(F.col("error").isNull(), F.col("url")).alias("url"), "format", "error")


# -- extraction in SQL ---------------------------------------------------------------------


@query(_SQL["q_html_links"])
def q_html_table_function(spark, sf_dir):
    """The links of each page, by a table function in SQL."""
    tablefunction.register(spark)
    closed(table(spark, sf_dir, "pages")).createOrReplaceTempView("gleaner_pages")
    return spark.sql("""select * from extract_html(table(gleaner_pages), '{"container": "nav ul > li", "text": "a"}', 'page_id')""")
