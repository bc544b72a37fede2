"""Query and SQL of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelight.operators.periods import periods_and_gaps, whole_ms
from cuelight.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "segments").select("config", "stem", "reel", "start_s", "end_s")
    s = s.where("start_s is not null and end_s > start_s").select("config", "stem", "reel", whole_ms("start_s").alias("a"), whole_ms("end_s").alias("b"))
    return periods_and_gaps(s, ["config", "stem", "reel"], "a", "b")


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
with s as (select distinct config, stem, reel, cast(round(start_s * 1000) as bigint) a, cast(round(end_s * 1000) as bigint) b
           from segments where start_s is not null and end_s > start_s),
r as (select *, max(b) over (partition by config, stem, reel order by a, b rows between unbounded preceding and 1 preceding) m from s where a < b),
i as (select *, sum(case when m is null or a > m then 1 else 0 end) over (partition by config, stem, reel order by a, b rows unbounded preceding) k from r),
p as (select config, stem, reel, k, min(a) start_ms, max(b) end_ms from i group by all),
g as (select config, stem, reel, lag(end_ms) over (partition by config, stem, reel order by start_ms) start_ms, start_ms end_ms from p)
select config, stem, reel, 'period' kind, start_ms, end_ms from p
union all select config, stem, reel, 'gap', start_ms, end_ms from g where start_ms is not null"""
}
