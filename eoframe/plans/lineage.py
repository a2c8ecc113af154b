"""Provenance with all its fields, lineage as a graph, the versioned store, and files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.operators import lineage as ln
from eoframe.operators import provenance as pv
from eoframe.plans.registry import query
from eoframe.session import shared_dir
from eoframe.sources import readers, writers
from eoframe.sources.adapters import Tables, oracle
from eoframe.sources.store import VersionedStore

# A record per order line. It derives from the line before, every third one also from the line two before, the first line from
# the customer's image, which no record has; in one of 97 orders the first line derives from the last, too.
_LINKS = """recs as (select distinct l_orderkey as o, l_linenumber as n, cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(4)) as id from lineitem),
    ends as (select o, max(n) as last from recs group by o),
    links as (select id, cast(o as varchar(20)) || '-' || cast(n - 1 as varchar(4)) as parent from recs where n > 1
      union select id, cast(o as varchar(20)) || '-' || cast(n - 2 as varchar(4)) from recs where n > 2 and n % 3 = 0
      union select id, 'image-' || cast(o % 50 as varchar(20)) from recs where n = 1
      union select id, cast(o as varchar(20)) || '-' || cast(last as varchar(4)) from recs join ends using (o) where n = 1 and o % 97 = 0)"""
_CLOSURE = f"""with recursive {_LINKS},
    reach as (select id, parent as ancestor, 1 as d from links union select r.id, l.parent, r.d + 1 from reach r join links l on r.ancestor = l.id where r.d < 9),
    closed as (select id, ancestor, min(d)::bigint as distance from reach group by 1, 2)"""


def _records(t: Tables) -> DataFrame:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    lines = lines.join(lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last")), "l_orderkey")

    def name(k) -> F.Column:
        return F.concat_ws("-", o.cast("string"), k.cast("string"))

    parents = F.array_compact(F.array(
        F.when(n > 1, name(n - 1)), F.when((n > 2) & (n % 3 == 0), name(n - 2)),
        F.when(n == 1, F.concat(F.lit("image-"), (o % 50).cast("string"))), F.when((n == 1) & (o % 97 == 0), name(F.col("last"))),
    ))
    return lines.select(name(n).alias("output_id"), parents.alias("lineage_parent_ids"))


@query(oracle(_CLOSURE + " select id, ancestor, distance from closed"))
def lineage_closure(t: Tables) -> DataFrame:
    return ln.lineage_closure(ln.parent_links(_records(t)))


@query(oracle(_CLOSURE + """ select recs.id, count(c.ancestor) as n_ancestors, count(c.ancestor) filter (where c.ancestor not in (select id from links)) as n_sources,
      count(c.ancestor) filter (where c.ancestor not in (select id from recs)) as n_unknown, coalesce(max(c.distance), 0) as depth, coalesce(bool_or(c.id = c.ancestor), false) as in_cycle
    from recs left join closed c on c.id = recs.id group by recs.id"""))
def lineage_summary(t: Tables) -> DataFrame:
    records = _records(t)
    return ln.lineage_summary(records, ln.lineage_closure(ln.parent_links(records)))


_TIME = "'2024-01-' || lpad(cast(k % 28 + 1 as varchar(2)), 2, '0') || 'T00:00:00+00:00'"


@query(oracle(f"""select case when k % 4 <> 0 then sha256(source_id) else 'unhashed-ref-' || source_id end as input_hash, 'sha256' as hash_algorithm, image_id as input_id,
      source_id as source_filename, file_format, modality, sensor, 'detector' as model_name, case when k % 3 = 0 then 'v2' else 'UNKNOWN' end as model_version,
      case when k % 5 = 0 then 'ckpt-' || cast(k % 7 as varchar(2)) else 'UNKNOWN' end as checkpoint, case when k % 2 = 0 then 'local' end as model_provider,
      'grounding' as task, {_TIME} as timestamp, 'run-1' as run_id, case when k % 6 = 0 then 'PREPROCESS' else 'INFERENCE' end as processing_stage,
      case when k % 4 = 1 then 'iou=0.5,k=' || cast(k % 10 as varchar(4)) else '' end as parameters,
      case when k % 9 = 0 then 'given-' || cast(k as varchar(20)) else 'out-' || substr(sha256('run-1|' || case when k % 4 <> 0 then sha256(source_id)
        else 'unhashed-ref-' || source_id end || '|detector|grounding|' || case when k % 6 = 0 then 'PREPROCESS' else 'INFERENCE' end), 1, 8) end as output_id,
      case when k % 3 = 1 then 'img-' || cast(k - 1 as varchar(20)) else '' end as parents from images""", "images"))
def provenance_full(t: Tables) -> DataFrame:
    """Records with every field: provider, time, parameters, given output ids and parents."""
    k = F.col("k")
    runs = t.images.select(
        "image_id", "source_id", F.when(k % 4 != 0, F.sha2("source_id", 256)).alias("sha256"), "file_format", "modality", "sensor",
        F.lit("detector").alias("model_name"), F.when(k % 3 == 0, F.lit("v2")).alias("model_version"),
        F.when(k % 5 == 0, F.concat(F.lit("ckpt-"), (k % 7).cast("string"))).alias("checkpoint"),
        F.when(k % 2 == 0, F.lit("local")).alias("model_provider"), F.lit("grounding").alias("task"),
        F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00+00:00")).alias("timestamp"),
        F.when(k % 6 == 0, F.lit("PREPROCESS")).alias("stage"),
        F.when(k % 4 == 1, F.create_map(F.lit("iou"), F.lit("0.5"), F.lit("k"), (k % 10).cast("string"))).alias("execution_parameters"),
        F.when(k % 9 == 0, F.concat(F.lit("given-"), k.cast("string"))).alias("output_id"),
        F.when(k % 3 == 1, F.array(F.concat(F.lit("img-"), (k - 1).cast("string")))).alias("lineage_parent_ids"),
    )
    pairs = F.transform(F.array_sort(F.map_entries("execution_parameters")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return pv.provenance_records(runs, "run-1").withColumns({
        "parameters": F.array_join(pairs, ","), "parents": F.array_join("lineage_parent_ids", ",")
    }).drop("execution_parameters", "lineage_parent_ids")


@query(oracle("""with st as (select patch_id, 'old-s2' as s2, case when ck % 3 = 0 then 'old-s1' end as s1 from patches where ck % 4 <> 0),
    nw as (select patch_id, case when ck % 2 = 0 then 'new-s2' end as s2, case when ck % 7 <> 0 then 'new-s1' end as s1 from patches where ck % 5 <> 0),
    one as (select coalesce(n.patch_id, s.patch_id) as patch_id, coalesce(n.s2, s.s2) as s2, coalesce(n.s1, s.s1) as s1 from st s full join nw n on s.patch_id = n.patch_id),
    two as (select patch_id, 'last' as s2, cast(null as varchar) as s1 from patches where ck = 1)
    select 0 as version, * from st union all select 1, * from one union all select 2, * from (select * from one where patch_id not in (select patch_id from two)
      union all select * from two)""", "patches"))
def versioned_store(t: Tables) -> DataFrame:
    """Three versions of a patch store, each read after the last was written: new, merged field by field, and a few patches replaced."""
    ck, p, none = F.col("ck"), t.patches, F.lit(None).cast("string")
    store = VersionedStore(t.spark, shared_dir(t.spark, "versions"), buckets=8)
    store.upsert(p.where(ck % 4 != 0).select("patch_id", F.lit("old-s2").alias("s2"), F.when(ck % 3 == 0, "old-s1").otherwise(none).alias("s1")))
    store.upsert(
        p.where(ck % 5 != 0).select("patch_id", F.when(ck % 2 == 0, "new-s2").alias("s2"), F.when(ck % 7 != 0, "new-s1").alias("s1")),
        merge={c: F.coalesce(f"new.{c}", f"old.{c}") for c in ("s2", "s1")},
    )
    store.upsert(p.where(ck == 1).select("patch_id", F.lit("last").alias("s2"), none.alias("s1")))
    parts = [store.read(v).select(F.lit(v).alias("version"), "patch_id", "s2", "s1") for v in store.versions()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _page_files(t: Tables) -> str:
    """Every page's html as a file: odd pages as .npz, even ones as .tif or .TIFF."""
    path, page = shared_dir(t.spark, "page-files"), F.col("page_id")
    ending = F.when(page % 2 == 1, F.lit(".npz")).when(page % 4 == 0, F.lit(".tif")).otherwise(F.lit(".TIFF"))
    files = t.pages.select(F.concat(page.cast("string"), ending).alias("name"), F.col("html").cast("binary").alias("content"))
    writers.write_files(files, path).write.format("noop").mode("overwrite").save()
    return path


@query("select cast(page_id as varchar) as patch_id, octet_length(encode(html))::bigint as size_bytes from pages where page_id % 2 = 1 and html is not null")
def imagery_index_files(t: Tables) -> DataFrame:
    return readers.imagery_index(t.spark, _page_files(t))


_TIF = "case when page_id % 4 = 0 then '.tif' else '.tiff' end"


@query(f"""select cast(page_id as varchar) as name, {_TIF} as extension, octet_length(encode(html))::bigint as size_bytes, sha256(html) as sha256
    from pages where page_id % 2 = 0 and html is not null""")
def raster_catalog_files(t: Tables) -> DataFrame:
    found = readers.raster_catalog(t.spark, _page_files(t))
    return found.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"), "extension", "size_bytes", "sha256")


@query("""select page_id, page_id % 2 = 0 and page_id % 3 <> 0 and html is not null as verified from pages""")
def file_verification(t: Tables) -> DataFrame:
    """Hashes of files' content against expected ones: some wrong, upper case and padded; odd pages are no rasters, so unknown."""
    page = F.col("page_id")
    catalog = readers.raster_catalog(t.spark, _page_files(t)).withColumn("path", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    told = F.when(page % 3 == 0, F.sha2(F.concat(F.lit("not "), F.coalesce("html", F.lit(""))), 256)).otherwise(F.sha2("html", 256))
    expected = t.pages.select(page.cast("string").alias("path"), F.concat(F.lit(" "), F.upper(told), F.lit("\n")).alias("expected_hash"))
    return pv.verify_hash(catalog, expected).select(F.col("path").cast("long").alias("page_id"), "verified")
