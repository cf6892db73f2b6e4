"""Queries of retrieval, usage and audit aggregates, set operations, samples and typed
sub-queries, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeframe.operators import graph, quality, retrieval, sampling
from lodeframe.plans import spec
from lodeframe.plans.stage import ctes, stage, table

Q, SQL = {}, {}
_r = lambda c, n=6: F.round(c, n)

# chunks and text quality
Q["chunks"] = lambda s, d: retrieval.chunks(table(s, d, "documents").select("doc_id", "text"), "text", 1500, 200).select("doc_id", "chunk", "start", F.sha2(F.col("chunk_text").cast("binary"), 256).alias("sha"))
SQL["chunks"] = """with c as (select doc_id, text, unnest(range(0, greatest(length(text), 1), 1300)) as start from documents where length(text) > 0)
select doc_id, cast(start // 1300 as integer) as chunk, cast(start as integer) as start, sha256(substring(text, start + 1, 1500)) as sha from c"""
Q["window_chunks"] = lambda s, d: retrieval.chunks(table(s, d, "documents").select("doc_id", "text"), "text", 1500, 200, keep_stepping=False).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"))
SQL["window_chunks"] = """with n as (select doc_id, length(text) as n from documents where length(text) > 0), c as (select doc_id, n, unnest(range(0, greatest(cast(ceil((n - 1500) / 1300.0) as bigint), 0) + 1)) * 1300 as start from n)
select doc_id, count(*) as chunks, cast(sum(least(1500, n - start)) as bigint) as chars from c where start < n group by doc_id"""
Q["parent_chunks"] = lambda s, d: retrieval.parents(retrieval.chunks(table(s, d, "documents").select("doc_id", "text"), "text"), "doc_id", 3).select("doc_id", "parent", "children", F.length("parent_text").cast("long").alias("chars"))
SQL["parent_chunks"] = """with c as (select doc_id, text, unnest(range(0, length(text), 1300)) as start from documents where length(text) > 0)
select doc_id, cast(start // 3900 as integer) as parent, cast(count(*) as integer) as children, cast(sum(length(substring(text, start + 1, 1500))) + count(*) - 1 as bigint) as chars from c group by 1, 2"""


def _text_quality(s, d):
    n, share = retrieval.quality(F.col("text"), ["the", "of", "and", "de", "la"])
    return table(s, d, "documents").select("doc_id", n.alias("vocabulary"), _r(share).alias("stopword_share"))


Q["text_quality"] = _text_quality
SQL["text_quality"] = r"""with w as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '') as w from documents)
select doc_id, cast(len(list_distinct(w)) as integer) as vocabulary, round(len(list_filter(w, lambda x: x in ('the', 'of', 'and', 'de', 'la'))) / nullif(len(w), 0), 6) as stopword_share from w"""

# ranking
_asked = lambda s, d: table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
_sparse = lambda s, d, k: retrieval.sparse_best(table(s, d, "documents").select("doc_id", "text"), _asked(s, d), k)
BM25 = r"""with w as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
), t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from w) group by 1, 2
), q as (select distinct item_id as query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from benchmark
), df as (select term, count(*) as df from t group by 1), st as (select count(*) as n, avg(len(w)) as avgdl from w
), bm as (select query_id, t.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w.w) / avgdl))) as score
  from q join t using (term) join df using (term) join w on w.doc_id = t.doc_id, st group by 1, 2)"""
Q["sparse_top"] = lambda s, d: _sparse(s, d, 20)
SQL["sparse_top"] = BM25 + " select * from (select query_id, doc_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as integer) as rank from bm) where rank <= 20"


def _dense(s, d, depth):
    return retrieval.dense_top(table(s, d, "embeddings"), F.col("vec_id") % 20 == 0, depth)


DENSE = """de as (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from (
  select a.vec_id as query_id, b.vec_id as doc_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id))"""
Q["dense_top"] = lambda s, d: _dense(s, d, 10)
SQL["dense_top"] = "with " + DENSE + " select * from de where rank <= 10"
Q["hybrid_fusion"] = lambda s, d: retrieval.fuse([_sparse(s, d, 100), _dense(s, d, 100)], ["query_id", "doc_id"]).withColumn("rrf", _r(F.col("rrf"), 8))
SQL["hybrid_fusion"] = BM25 + ", " + DENSE + """, sp as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from bm
), u as (select query_id, doc_id, rank from sp where rank <= 100 union all select query_id, doc_id, rank from de where rank <= 100)
select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 8) as rrf from u group by 1, 2"""
Q["diverse_evidence"] = lambda s, d: retrieval.mmr(_sparse(s, d, 20).join(table(s, d, "documents").select("doc_id", "text"), "doc_id"), "query_id", "doc_id", 5)
_evidence = lambda s, d: stage(s, d, "usage")
Q["round_robin"] = lambda s, d: retrieval.round_robin(_evidence(s, d), "user_id", "event_type", [F.desc("cost"), F.col("event_id")], ["purchase", "view"], 12).select("user_id", "event_id", "position")
SQL["round_robin"] = ctes("usage") + """, t as (select *, row_number() over (partition by user_id, event_type order by cost desc, event_id) as turn, case event_type when 'purchase' then 1 when 'view' then 2 else 3 end as f from usage
), p as (select user_id, event_id, cast(row_number() over (partition by user_id order by turn, f, event_type) as integer) as position from t) select * from p where position <= 12"""
Q["kind_quotas"] = lambda s, d: retrieval.quotas(_evidence(s, d), "user_id", "event_type", [F.desc("cost"), F.col("event_id")], {"view": 1}, 2).select("user_id", "event_id")
SQL["kind_quotas"] = ctes("usage") + " select user_id, event_id from (select *, row_number() over (partition by user_id, event_type order by cost desc, event_id) as rn from usage) where rn <= case event_type when 'view' then 1 else 2 end"
Q["budget_trim"] = lambda s, d: retrieval.within_budget(_evidence(s, d), "user_id", [F.desc("cost"), F.col("event_id")], "cost", 20000).select("user_id", "event_id", "spent")
SQL["budget_trim"] = ctes("usage") + " select user_id, event_id, spent from (select user_id, event_id, sum(cost) over (partition by user_id order by cost desc, event_id rows unbounded preceding) as spent from usage) where spent <= 20000"
Q["trust"] = lambda s, d: stage(s, d, "usage").groupBy("user_id").agg(F.avg(F.col("event_type").isin("click", "view").cast("double")).alias("c")).select("user_id", _r(retrieval.trust_score(F.col("c"), F.lit(0.5), F.lit(0.7))).alias("trust"), _r(retrieval.boosted(F.lit(2.0), F.col("c"))).alias("boosted"))
SQL["trust"] = ctes("usage") + ", c as (select user_id, avg(case when event_type in ('click', 'view') then 1.0::double else 0 end) as c from usage group by 1) select user_id, round(greatest(0, least(1, 0.60 * c + 0.125 + 0.105)), 6) as trust, round(2 * (1 + 0.2 * (c - 0.5)), 6) as boosted from c"

# usage, telemetry and audit
Q["daily_usage"] = lambda s, d: stage(s, d, "usage").groupBy(F.to_date("ts").cast("string").alias("day"), "workspace_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.sum("cost").alias("cost"))
SQL["daily_usage"] = ctes("usage") + " select cast(cast(ts as date) as varchar) as day, workspace_id, count(*) as n, count(*) filter (where event_type = 'purchase') as purchases, sum(cost) as cost from usage group by 1, 2"
Q["telemetry_percentiles"] = lambda s, d: stage(s, d, "usage").groupBy("event_type").agg(F.count("*").alias("n"), _r(F.avg("cost"), 4).alias("mean_cost"), F.expr("percentile_disc(0.95) within group (order by cost)").alias("p95"), F.expr("percentile_cont(0.5) within group (order by cost)").alias("median"))
SQL["telemetry_percentiles"] = ctes("usage") + " select event_type, count(*) as n, round(avg(cost), 4) as mean_cost, quantile_disc(cost, 0.95) as p95, quantile_cont(cost, 0.5) as median from usage group by 1"
Q["top_props"] = lambda s, d: stage(s, d, "usage").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10)
SQL["top_props"] = ctes("usage") + " select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from usage group by 1 order by n desc, k limit 10"
Q["json_keys"] = lambda s, d: stage(s, d, "usage").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
SQL["json_keys"] = ctes("usage") + " select key, count(*) as n from (select unnest(json_keys(props)) as key from usage) group by 1"
Q["hourly_spend"] = lambda s, d: stage(s, d, "usage").groupBy("workspace_id", F.window("ts", "1 hour")["start"].cast("string").alias("hour")).agg(F.sum("cost").alias("cost")).where("cost > 500")
SQL["hourly_spend"] = ctes("usage") + " select workspace_id, cast(date_trunc('hour', ts) as varchar) as hour, sum(cost) as cost from usage group by 1, 2 having sum(cost) > 500"
Q["first_purchase"] = lambda s, d: stage(s, d, "usage").where("event_type = 'purchase'").groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
SQL["first_purchase"] = ctes("usage") + " select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as rn from usage where event_type = 'purchase') where rn = 1"
Q["prior_run"] = lambda s, d: stage(s, d, "usage").select("event_id", F.coalesce(F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")), F.lit(-1)).alias("prior_id"))
SQL["prior_run"] = ctes("usage") + " select event_id, coalesce(lag(event_id) over (partition by user_id, event_type order by ts, event_id), -1) as prior_id from usage"
Q["stale_runs"] = lambda s, d: stage(s, d, "usage").groupBy("user_id").agg(F.max("ts").alias("beat"), F.max_by("event_type", F.struct("ts", "event_id")).alias("stage")).where(F.col("beat") < F.when(F.col("stage") == "view", F.lit("2024-01-30 12:00:00").cast("timestamp")).otherwise(F.lit("2024-01-30 15:00:00").cast("timestamp"))).select("user_id", "stage")
SQL["stale_runs"] = ctes("usage") + ", l as (select user_id, max(ts) as beat, arg_max(event_type, row(ts, event_id)) as stage from usage group by 1) select user_id, stage from l where beat < case when stage = 'view' then timestamp '2024-01-30 12:00:00' else timestamp '2024-01-30 15:00:00' end"


def _unacknowledged(s, d):
    """Purchases without a click of the user within a day: clicks meet their own and the day before."""
    u = stage(s, d, "usage").withColumn("day", F.to_date("ts"))
    bought, clicks = u.where("event_type = 'purchase'"), u.where("event_type = 'click'").select("user_id", F.col("ts").alias("clicked"), F.explode(F.array("day", F.date_sub("day", 1))).alias("day"))
    answered = bought.join(clicks, ["user_id", "day"]).where((F.col("clicked") > F.col("ts")) & (F.col("clicked") <= F.col("ts") + F.expr("interval 1 day"))).select("event_id").distinct()
    return bought.join(answered, "event_id", "left_anti").select("event_id")


Q["unacknowledged"] = _unacknowledged
SQL["unacknowledged"] = ctes("usage") + " select event_id from usage a where event_type = 'purchase' and not exists (select 1 from usage b where b.user_id = a.user_id and b.event_type = 'click' and b.ts > a.ts and b.ts <= a.ts + interval 1 day)"
Q["json_per_hole"] = lambda s, d: stage(s, d, "assay").where("value_ppm is not null").groupBy("collar_id", "element").agg(F.max("value_ppm").alias("v")).groupBy("collar_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", F.col("v").cast("long").alias("v")))), lambda x: F.concat_ws("=", x["element"], x["v"])), ";").alias("best"), F.min_by("v", "element").alias("first_value"))
SQL["json_per_hole"] = ctes("assay") + ", m as (select collar_id, element, max(value_ppm) as v from assay where value_ppm is not null group by 1, 2) select collar_id, string_agg(element || '=' || cast(cast(v as bigint) as varchar), ';' order by element) as best, arg_min(v, element) as first_value from m group by 1"
Q["wide_assays"] = lambda s, d: stage(s, d, "assay").groupBy("collar_id").pivot("element", ["A", "N", "R"]).agg(F.max("value_ppm"))
SQL["wide_assays"] = ctes("assay") + ' select collar_id, max(value_ppm) filter (where element = \'A\') as "A", max(value_ppm) filter (where element = \'N\') as "N", max(value_ppm) filter (where element = \'R\') as "R" from assay group by 1'
Q["attribute_flags"] = lambda s, d: stage(s, d, "collar").join(stage(s, d, "assay").select("collar_id").distinct().withColumn("a", F.lit(True)), "collar_id", "left").select("collar_id", F.coalesce("a", F.lit(False)).alias("has_assay"))
SQL["attribute_flags"] = ctes("collar", "assay") + " select collar_id, exists (select 1 from assay a where a.collar_id = c.collar_id) as has_assay from collar c"
Q["orphans"] = lambda s, d: stage(s, d, "collar").join(stage(s, d, "assay"), "collar_id", "left_anti").select("collar_id")
SQL["orphans"] = ctes("collar", "assay") + " select collar_id from collar c where not exists (select 1 from assay a where a.collar_id = c.collar_id)"
Q["tagged_union"] = lambda s, d: stage(s, d, "collar").select("project_id", F.lit("hole").alias("kind")).unionByName(stage(s, d, "collar").where("status = 'F'").select("project_id", F.lit("finished").alias("kind"))).groupBy("project_id", "kind").agg(F.count("*").alias("n"))
SQL["tagged_union"] = ctes("collar") + " select project_id, kind, count(*) as n from (select project_id, 'hole' as kind from collar union all select project_id, 'finished' from collar where status = 'F') group by 1, 2"
Q["priority_match"] = lambda s, d: stage(s, d, "collar").withColumn("p", F.when(F.col("hole_id") == "ddh-12", 1).when(F.replace("hole_id", F.lit("-"), F.lit("")) == "ddh12", 2).when(F.col("hole_id").contains("12"), 3)).where("p is not null").withColumn("rn", F.row_number().over(Window.partitionBy("project_id").orderBy("p", "collar_id"))).where("rn = 1").select("project_id", "collar_id", "p")
SQL["priority_match"] = ctes("collar") + ", m as (select *, case when hole_id = 'ddh-12' then 1 when replace(hole_id, '-', '') = 'ddh12' then 2 when contains(hole_id, '12') then 3 end as p from collar), r as (select *, row_number() over (partition by project_id order by p, collar_id) as rn from m where p is not null) select project_id, collar_id, p from r where rn = 1"
Q["page_of_holes"] = lambda s, d: stage(s, d, "collar").orderBy("drill_date", "collar_id").offset(100).limit(50).select("collar_id")
SQL["page_of_holes"] = ctes("collar") + " select collar_id from collar order by drill_date, collar_id limit 50 offset 100"

# typed sub-queries, graphs and samples
Q["typed_aggregate"] = lambda s, d: spec.run(spec.for_workspace(stage(s, d, "collar"), 3), spec.Aggregate("stddev", "total_depth", ("hole_type",), {"status": ["F", "O"], "azimuth": (10, 300), "hole_id": None})).withColumn("value", _r(F.col("value"), 4))
SQL["typed_aggregate"] = ctes("collar") + " select hole_type, round(stddev_samp(total_depth), 4) as value from collar where workspace_id = 3 and status in ('F', 'O') and azimuth between 10 and 300 group by 1"
Q["typed_top"] = lambda s, d: spec.run(stage(s, d, "assay"), spec.Aggregate("count", "*", ("element",), {}, 12))
SQL["typed_top"] = ctes("assay") + " select element, count(*) as value from assay group by 1 order by value desc, element limit 12"
_edges = lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1500).alias("dst")).distinct()
Q["graph_reach"] = lambda s, d: graph.reach(_edges(s, d), s.createDataFrame([(1,)], "node long"), 2)
SQL["graph_reach"] = """with e as (select distinct o_custkey as src, o_orderkey % 1500 as dst from orders), a as (select distinct dst from e where src = 1 and dst <> 1), b as (select distinct e.dst from e join a on e.src = a.dst)
select cast(1 as bigint) as node, 0 as hops union all select dst, 1 from a union all select dst, 2 from b where dst <> 1 and dst not in (select dst from a)"""
Q["ancestors"] = lambda s, d: graph.ancestors(s, table(s, d, "nation").select(F.col("n_nationkey").alias("child"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("parent")).where("child <> parent"))
SQL["ancestors"] = """with recursive p as (select n_nationkey as child, n_nationkey // 2 as parent from nation where n_nationkey <> n_nationkey // 2), up as (select child, parent as ancestor, 1 as n from p union all select u.child, p.parent, u.n + 1 from up u join p on u.ancestor = p.child where u.n < 20)
select child, ancestor, min(n) as steps from up group by 1, 2"""
Q["sqrt_slots"] = lambda s, d: sampling.sqrt_slots(stage(s, d, "collar"), "hole_type", 500)
SQL["sqrt_slots"] = ctes("collar") + ", n as (select hole_type, count(*) as n from collar group by 1) select hole_type, n, least(n, greatest(1, cast(round(sqrt(n) / sum(sqrt(n)) over () * 500) as bigint))) as slots from n"
Q["stratified_sample"] = lambda s, d: sampling.stratified(stage(s, d, "collar"), "hole_type", "collar_id", 500, 42).select("hole_type", "collar_id")
Q["seeded_split"] = lambda s, d: stage(s, d, "collar").groupBy(sampling.split(F.col("collar_id"), 42).alias("part")).agg(F.count("*").alias("n"))
Q["hard_negatives"] = lambda s, d: sampling.hard_negatives(_dense(s, d, 50).join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("g")), "doc_id").join(table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id"), "query_id", "g", "own", [(1, 10, 2), (11, 30, 3), (31, 50, 4)], "doc_id", 7).select("query_id", "doc_id", "band")
Q["majority_status"] = lambda s, d: sampling.majority(stage(s, d, "collar"), ["project_id"], "hole_type")
SQL["majority_status"] = ctes("collar") + ", n as (select project_id, hole_type, row_number() over (partition by project_id order by count(*) desc, hole_type) as rn from collar group by 1, 2) select project_id, hole_type from n where rn = 1"
Q["changed_keys"] = lambda s, d: quality.compare(table(s, d, "customer").where("c_custkey % 3 <> 0"), table(s, d, "customer").where("c_custkey % 4 <> 0"), "c_custkey", "c_name").groupBy("state").agg(F.count("*").alias("n"))
SQL["changed_keys"] = "select case when c_custkey % 3 = 0 then 'added' when c_custkey % 4 = 0 then 'removed' else 'same' end as state, count(*) as n from customer where c_custkey % 12 <> 0 group by 1"
