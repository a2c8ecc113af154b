"""Health replay and the streaming jobs, run over the test tables as file streams until nothing is left to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.operators import health as hl
from eoframe.operators import query_log as ql
from eoframe.plans import quality as quality_plans
from eoframe.plans import requests as request_plans
from eoframe.plans.registry import query
from eoframe.sources.adapters import Tables, oracle
from eoframe.streaming import flows, gather, health
from eoframe.streaming.runtime import run_to_parquet, table_stream


class StreamTables(Tables):
    """The same views with the named base tables read as streams and all others static."""

    def __init__(self, t: Tables, *streamed: str):
        super().__init__(t.spark, t.sf_dir)
        self.streamed = streamed

    def base(self, name: str) -> DataFrame:
        return table_stream(self.spark, self.sf_dir, name) if name in self.streamed else super().base(name)


HEALTH = """with recursive log as (select *, row_number() over (partition by service order by ts_ms, event_id) as rn from calls),
    run(service, rn, state, since, decision, ok, move, event_id) as (
      select service, cast(0 as bigint), 0, cast(0 as bigint), '', 0, '', cast(-1 as bigint) from (select distinct service from log) s
      union all
      select l.service, l.rn,
        case when r.state = 3 then case when l.ts_ms - r.since < 10000 then 3 when l.ok = 1 then 0 else 3 end when l.ok = 1 then 0 when r.state = 2 then 3 else r.state + 1 end,
        case when r.state = 3 then case when l.ts_ms - r.since < 10000 then r.since when l.ok = 1 then 0 else l.ts_ms end when l.ok = 0 and r.state = 2 then l.ts_ms else 0 end,
        case when r.state = 3 and l.ts_ms - r.since < 10000 then 'rejected' else 'executed' end, l.ok,
        case when r.state = 3 then case when l.ts_ms - r.since < 10000 then '' when l.ok = 1 then 'OPEN>HALF_OPEN>CLOSED' else 'OPEN>HALF_OPEN>OPEN' end
          when l.ok = 0 and r.state = 2 then 'CLOSED>OPEN' else '' end, l.event_id
      from run r join log l on l.service = r.service and l.rn = r.rn + 1)"""
_DECISIONS = HEALTH + " select event_id, decision, case when state = 3 then 'OPEN' else 'CLOSED' end as state, move as transition from run where rn > 0"


@query(oracle(_DECISIONS, "calls"))
def service_health(t: Tables) -> DataFrame:
    return hl.service_health(t.calls).select("event_id", "decision", "state", "transition")


@query(oracle(HEALTH + """ select service, count(*) filter (where decision = 'executed') as total_calls, count(*) filter (where decision = 'executed' and ok = 1) as total_successes,
    count(*) filter (where decision = 'executed' and ok = 0) as total_failures, count(*) filter (where decision = 'rejected') as total_rejected,
    cast(sum(length(move) - length(replace(move, '>', ''))) as bigint) as n_transitions, case when arg_max(state, rn) = 3 then 'OPEN' else 'CLOSED' end as last_state
    from run where rn > 0 group by service""", "calls"))
def service_health_summary(t: Tables) -> DataFrame:
    return hl.health_summary(hl.service_health(t.calls))


@query(oracle(_DECISIONS, "calls"))
def health_stream(t: Tables) -> DataFrame:
    calls = StreamTables(t, "events").calls
    return run_to_parquet(health.health_stream(calls), "health").select("event_id", "decision", "state", "transition")


@query(oracle(f"""with m as (select o_orderkey as order_key, band, copy_no, copy_no * 6 + (ordinal * 7 + o_orderkey) % 10 + 1 + o_orderkey % 4 as pos,
      band || '@' || cast(copy_no as varchar(2)) as payload
    from orders cross join (select unnest({[*fv.PACKED_BANDS, "B09", "B02"]}) as band, generate_subscripts({[*fv.PACKED_BANDS, "B09", "B02"]}, 1) as i) s
      cross join lateral (select case when i = 12 then 1 else 0 end as copy_no, case when i = 12 then 1 else i end as ordinal) c
    where band <> 'B09' and not (band = 'B12' and o_orderkey % 9 = 0) and (copy_no = 0 or o_orderkey % 5 = 0)),
    f as (select order_key, band, min(pos) as first_at from m group by 1, 2),
    c as (select order_key, max(first_at) as completed_at from f group by 1 having count(*) = 10),
    h as (select m.order_key, completed_at, band, arg_max(payload, pos) as payload from m join c on m.order_key = c.order_key
      where pos <= completed_at group by 1, 2, 3)
    select order_key, cast(completed_at as int) as completed_at, string_agg(band || '=' || payload, ',' order by band) as payloads
    from h group by 1, 2"""))
def gather_stream(t: Tables) -> DataFrame:
    """Bands of each order's patch as a stream, in an order of its own; B02 comes twice for some, B12 never for others, so these
    are never emitted."""
    orders = StreamTables(t, "orders").orders
    names = [*fv.PACKED_BANDS, "B09", "B02"]
    specs = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(i + 1 if i < 11 else 1).alias("ordinal"), F.lit(i // 11).alias("copy_no"))
                      for i, b in enumerate(names)])
    key = F.col("o_orderkey")
    members = orders.select("o_orderkey", F.explode(specs).alias("s")).select(
        key.cast("string").alias("patch_id"), key.alias("k"), "s.*",
        (F.col("s.copy_no") * 6 + (F.col("s.ordinal") * 7 + key) % 10 + 1 + key % 4).alias("pos"),
        F.concat_ws("@", "s.band", F.col("s.copy_no").cast("string")).alias("payload"),
    )
    members = members.where(~((F.col("band") == "B12") & (F.col("k") % 9 == 0)) & ((F.col("copy_no") == 0) | (F.col("k") % 5 == 0)))
    rule = gather.SetRule("patch_id", "band", "payload", "pos", fv.PACKED_BANDS, ttl_ms=flows.PATIENCE_MS)
    done = gather.gather(members, rule)["sets"]
    held = F.array_sort(F.transform(F.map_entries("items"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return done.select(
        F.col("key").cast("bigint").alias("order_key"), F.col("completed_at").cast("int").alias("completed_at"),
        F.array_join(held, ",").alias("payloads"))


@query(oracle("select o_orderkey, patch_id from order_patches where patch_id not in (select patch_id from cached)", "order_patches", "cached"))
def skip_stored_stream(t: Tables) -> DataFrame:
    arriving = StreamTables(t, "orders").order_patches.select("o_orderkey", "patch_id")
    return run_to_parquet(gather.skip_stored(arriving, t.cached), "resume").select("o_orderkey", "patch_id")


@query(oracle(f"""with {request_plans.CLASSIFIED} select request_id, task, coalesce(refused, false) as refused, {request_plans._NEED} = input_scope and n_images < 3 as scope_ok from classified""",
              "requests"))
def classify_stream(t: Tables) -> DataFrame:
    arriving = request_plans.requests(StreamTables(t, "conversations"))
    out = flows.classify_stream(arriving, ql.registry_table(t.nation))
    return run_to_parquet(out.select("request_id", "task", F.col("reject_reason").isNotNull().alias("refused"), "scope_ok"), "classify")


@query(oracle(f"""with {quality_plans._IMG}, errs as ({quality_plans._image_errors_sql('img', 'k')})
    select k, case when k in (select k from errs) then 'rejected' else 'valid' end as sink from img""", "images"))
def validate_stream(t: Tables) -> DataFrame:
    sinks = flows.validate_stream(StreamTables(t, "part").image_records, quality_plans.CFG)
    parts = [df.select("k", F.lit(name).alias("sink")) for name, df in sinks.items()]
    return parts[0].union(parts[1])


_HELD = """firsts as (select request_id, model_name, min(position) as first_at from outputs group by 1, 2),
    done as (select request_id, max(first_at) as completed_at from firsts group by request_id),
    held as (select o.request_id, o.model_name, max(position) as position from outputs o join done d on o.request_id = d.request_id
      where position <= completed_at group by 1, 2),
    last_outputs as (select * from (select x.*, row_number() over (partition by x.request_id, x.model_name order by x.confidence) as nth from outputs x
      join held h on x.request_id = h.request_id and x.model_name = h.model_name and x.position = h.position) where nth = 1)"""


@query(oracle(f"""with {_HELD}, {quality_plans.REPORTS.replace("from outputs", "from last_outputs")},
    c as (select request_id, avg(confidence) as c from last_outputs group by request_id)
    select r.request_id, n_outputs, status, round(least(1, greatest(0, 0.7e0 * c + 0.3e0
      - case status when 'AGREEMENT' then 0 when 'PARTIAL_AGREEMENT' then 0.08e0 else 0.2e0 end)), 6) as final_confidence
    from reports r join c on r.request_id = c.request_id""", "outputs"))
def reconcile_stream(t: Tables) -> DataFrame:
    expected = t.outputs.groupBy("request_id").agg(F.countDistinct("model_name").alias("n_models"))
    out = flows.reconcile_stream(StreamTables(t, "lineitem").outputs, expected)
    return out.select("request_id", "n_outputs", "status", F.round("final_confidence", 6).alias("final_confidence"))


