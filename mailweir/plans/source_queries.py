"""Queries on files, rules and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweir.operators import rules as R
from mailweir.plans.registry import Registry
from mailweir.sources import files
from mailweir.sources.tables import table
from mailweir.streaming import ingest

query = Registry()

EXAMPLE_RULES = [
    {"id": "deadline", "code": "deadline", "regex": r"within [0-9]+ hours"},
    {"id": "secret", "code": "secret", "regex": r"password|mật khẩu"},
    {"id": "offer", "code": "offer", "regex": r"[0-9]+% (?:off|less)"},
]
_T = "coalesce(body,'')"


@query("html_text")
def html_text(spark, d):
    t = table(spark, d, "thu", ("id_thu", "noi_dung_html")).filter("noi_dung_html is not null and noi_dung_html <> ''")
    return t.select("id_thu", files.html_to_text(F.col("noi_dung_html")).alias("text"))


@query("sender_addresses", r"select id_thu, nullif(lower(regexp_extract(coalesce(nguoi_gui,''), '@([^@<>\s]+)>?\s*$', 1)), '') as domain from thu")
def sender_addresses(spark, d):
    """Every mail, whatever the shape of its sender."""
    t = table(spark, d, "thu", ("id_thu", "nguoi_gui"))
    return t.select("id_thu", files.mail_address(F.col("nguoi_gui")).alias("a")).select("id_thu", "a.domain")


@query(
    "rule_hits",
    f"select code, count(*) as n_rows, sum(n)::bigint as n_hits from (select 'deadline' as code, len(regexp_extract_all({_T}, 'within [0-9]+ hours')) as n from messages union all select 'secret', len(regexp_extract_all({_T}, 'password|mật khẩu')) from messages union all select 'offer', len(regexp_extract_all({_T}, '[0-9]+% (?:off|less)')) from messages) where n > 0 group by 1",
)
def rule_hits(spark, d):
    m = table(spark, d, "messages", ("id", "body")).select(F.explode(R.findings(F.col("body"), EXAMPLE_RULES)).alias("f"))
    return m.groupBy("f.code").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("f.n").alias("n_hits"))


@query(
    "rule_scores",
    f"""with c as (select id, (regexp_matches({_T}, 'within [0-9]+ hours'))::int * 12.0 + (regexp_matches({_T}, 'password|mật khẩu'))::int * 9.0 + (regexp_matches({_T}, '[0-9]+% (?:off|less)'))::int * 2.5 as s from messages), k as (select id, round_even(least(20.0, s), 0)::bigint as score from c)
    select id, score, case when score between 0 and 9 then 'LOW' when score between 10 and 14 then 'MEDIUM' when score between 15 and 100 then 'HIGH' end as level from k""",
)
def rule_scores(spark, d):
    codes = R.hit_codes(F.col("body"), EXAMPLE_RULES)
    m = table(spark, d, "messages", ("id", "body")).select("id", F.bround(R.capped_sum(codes, {"deadline": 12.0, "secret": 9.0, "offer": 2.5}, 20.0)).cast("bigint").alias("score"))
    return R.with_level(m, "score", [("LOW", 0, 9), ("MEDIUM", 10, 14), ("HIGH", 15, 100)])


def _named(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_tumbling_counts", "select strftime(time_bucket(interval '1 hour', ts::timestamp), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n from events group by all")
def stream_tumbling_counts(spark, d):
    return _named(ingest.drain(ingest.tumbling_counts(ingest.open_stream(spark, d, "events"), "ts", "1 hour", ["event_type"]), "complete"))


@query(
    "stream_sliding_sums",
    "select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, event_type, round(sum(value), 4) as total from (select event_type, value, unnest([time_bucket(interval '1 hour', ts::timestamp), time_bucket(interval '1 hour', ts::timestamp) - interval '1 hour']) as w from events) group by all",
)
def stream_sliding_sums(spark, d):
    out = ingest.drain(ingest.sliding_sums(ingest.open_stream(spark, d, "events"), "ts", "2 hours", "1 hour", ["event_type"], "value"), "complete")
    return _named(out).withColumn("total", F.round("total", 4))


@query(
    "stream_sessions",
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
    k as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, strftime(min(ts)::timestamp, '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n from k group by user_id, k""",
)
def stream_sessions(spark, d):
    """All sessions of a drained source, those too that are open at its end."""
    out = ingest.drain(ingest.sessions(ingest.open_stream(spark, d, "events"), "ts", "30 minutes", "user_id"), "complete")
    return out.withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_running_counts", "select cast(user_id as varchar) as key, count(*) as n from events group by 1")
def stream_running_counts(spark, d):
    out = ingest.drain(ingest.running_counts(ingest.open_stream(spark, d, "events"), "user_id"), "update", keep=lambda df: df.groupBy("key").agg(F.max("n").alias("n")))
    return out


@query("stream_first_deliveries", "select count(*) as n_rows, count(distinct ma_thu_ngoai) as n_keys from (select ma_thu_ngoai, row_number() over (partition by ma_thu_ngoai) as n from thu) where n = 1 or ma_thu_ngoai is null")
def stream_first_deliveries(spark, d):
    stream = ingest.open_stream(spark, d, "thu").withColumn("at", F.to_timestamp("thoi_gian_tao"))
    out = ingest.drain(ingest.first_seen(stream, "ma_thu_ngoai", "at", "3650 days"), "append")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ma_thu_ngoai").alias("n_keys"))


QUERIES, SQL = query.queries, query.sql
