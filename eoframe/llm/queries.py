"""The registered queries of this package: each applies one operator to a whole table; SQL stands beside those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe.llm import exact_dedup, mixing, nearest, packing, pages, periods, quality, repeats, sharding, simhash, threshold
from eoframe.llm import trie, wavelet
from eoframe.llm.tables import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("""
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
  doc_id = max(doc_id) over (partition by text) as kept, sha256(text) as text_sha256
from d
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.add_batch(exact_dedup.DigestIndex(spark), documents(spark, sf_dir))


@register("""
with v as (select vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  n as (select vec_id, e, list_inner_product(e, e) as sq from v),
  p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) / sqrt(q.sq * c.sq) as score
    from n q join n c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
  r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
""")
def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register()
def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file())


@register()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@register()
def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(sharding.sized_rows(documents(spark, sf_dir)), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register()
def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@register()
def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register(f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) as size,
    greatest(0.1::double, 1.0::double - 4.0::double * (length(coalesce(text, ''))
      - length(translate(coalesce(text, ''), '{mixing.SYMBOLS}', '')))::double
      / greatest(length(coalesce(text, '')), 1)::double) as weight from documents),
  k as (select *, -ln((('0x' || substr(md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 12))::bigint
      + 0.5::double) / 281474976710656.0::double) / weight as key from d),
  s as (select source, sum(size)::bigint as source_size, ([5.0, 2.0, 1.0]::double[])[1 + (row_number()
      over (order by source asc nulls last) - 1) % 3] as w from d group by source),
  l as (select *, (1.5::double * sum(source_size) over ()::double - coalesce(sum(2.0::double * source_size::double)
      over (order by 2.0::double * source_size / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by 2.0::double * source_size / w, source asc nulls last
        rows between current row and unbounded following) as level from s),
  t as (select source, source_size, least(2.0::double * source_size, coalesce(max(case when level <= 2.0::double
      * source_size / w then level end) over (), 'infinity'::double) * w) as target from l),
  e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
  r as (select k.*, source_size, target, epochs, target - epochs::double * source_size as missing,
      coalesce(sum(size) over (partition by k.source order by key, doc_id, size
        rows between unbounded preceding and 1 preceding), 0)::double as ahead
    from k join e on k.source is not distinct from e.source)
select doc_id, size::bigint as size, source_size, target, (epochs * size + case when ahead < missing
  and ahead + size - missing <= missing - ahead then size else 0 end)::bigint as taken from r
""")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized_documents(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register()
def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


@register()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(documents(spark, sf_dir), tokenizer_file())


@register("""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  p as (select q.r as query_row, q.vec_id as query_id, c.r, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
    from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
  k as (select *, row_number() over (partition by query_row order by score desc, vec_id nulls last, r) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, score from k where rank <= 10
""")
def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast({0} as varchar), ''), lambda ch: ord(ch)::bigint)),
  lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, i: xor(y >> 1, 3988292384::bigint * (y & 1)))),
  4294967295::bigint)"""


@register(f"""
with x as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
  t as (select conv_id, turn, md5(length(role) || ':' || role || text) as dg, length(text) as chars from x),
  o as (select *, row_number() over (partition by conv_id order by turn nulls first, dg) - 1 as pos from t),
  c as (select conv_id, conv_id - conv_id % 100 as base, {CRC32.format('conv_id')} % 6 as h from (select distinct conv_id from o)),
  r as (select c.conv_id, 0 as part, pos, dg, chars from c join o on o.conv_id = c.base and pos < h
    union all select c.conv_id, 1, pos, dg, chars from c join o on o.conv_id = c.conv_id and pos >= h),
  s as (select conv_id, dg, chars, row_number() over (partition by conv_id order by part, pos) as d from r),
  p as (select conv_id, d, chars, md5(string_agg(dg, '') over (partition by conv_id order by d)) as node from s
    union all select conv_id, 0, 0, '' from c),
  n as (select d, node, min(conv_id) as m, count(*) as n_convs, any_value(chars) as chars from p group by d, node),
  a as (select n.d, n.node, n.m, n.n_convs, n.chars, p.d as up_d, p.node as up from n join p on p.conv_id = n.m and p.d <= n.d),
  k as (select up_d as d, up as node, count(*) filter (where d = up_d + 1) as n_children,
    sum((n_convs - 1) * chars)::bigint as saved_tokens from a group by 1, 2),
  f as (select a.up_d as d, a.up as node, count(*) as n_leaves from a join k on k.d = a.d and k.node = a.node
    where k.n_children = 0 group by 1, 2),
  e as (select d, node, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
    from (select conv_id, d, node, row_number() over (partition by conv_id order by d desc) as last from p) where last = 1 group by 1, 2)
select n.m as conv_id, n.d as depth, q.m as parent_conv_id, n.n_convs, k.n_children, f.n_leaves, k.saved_tokens,
  sha256(coalesce(e.ids, '')) as ends_sha256
from n join k on k.d = n.d and k.node = n.node join f on f.d = n.d and f.node = n.node
left join a on a.d = n.d and a.node = n.node and a.up_d = n.d - 1 left join n q on q.d = a.up_d and q.node = a.up
left join e on e.d = n.d and e.node = n.node
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@register()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.periodic_runs(documents(spark, sf_dir), plant=True))
