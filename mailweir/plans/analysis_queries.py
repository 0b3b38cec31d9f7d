"""Queries on linkage, extraction, metrics and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweir.functions import extract as X
from mailweir.functions import text as T
from mailweir.operators import audit as A
from mailweir.operators import linkage as K
from mailweir.operators import metrics as M
from mailweir.plans.registry import Registry
from mailweir.session import cut
from mailweir.sources.tables import table

query = Registry()
BODY = "coalesce(body,'')"


def _messages(spark, d, *columns):
    return table(spark, d, "messages", ("id", *columns))


# ---------------------------------------------------------------- extraction

TAIL = r"[.,;:!?)\]}>]+$"
URL_SQL = r"(?i)(?:https?://|www\.)[^\t\n\v\f\r <>\"'']+"


@query("extract_urls", f"select id, array_to_string(list_transform(regexp_extract_all({BODY}, '{URL_SQL}'), lambda x: regexp_replace(x, '{TAIL}', '')), ' ') as urls from messages where len(regexp_extract_all({BODY}, '{URL_SQL}')) > 0")
def extract_urls(spark, d):
    found = X.urls(F.col("body"))
    return _messages(spark, d, "body").select("id", found.alias("u")).filter(F.size("u") > 0).select("id", F.array_join("u", " ").alias("urls"))


@query("malformed_urls")
def malformed_urls(spark, d):
    return _messages(spark, d, "body").select("id", F.explode(X.malformed_urls(F.col("body"))).alias("url"))


@query("url_hosts")
def url_hosts(spark, d):
    anchors = F.explode(F.concat(X.urls(F.col("body")), X.malformed_urls(F.col("body"))))
    parts = _messages(spark, d, "body").select(anchors.alias("url")).select(X.url_parts(F.col("url")).alias("p")).select("p.*")
    return parts.groupBy("domain", "is_ip", "punycode", "obfuscated").agg(F.count(F.lit(1)).alias("n_rows"), F.max("length").alias("longest"), F.max("depth").alias("deepest"))


@query(
    "url_parse",
    f"""with u as (select id, unnest(list_transform(regexp_extract_all({BODY}, '(?i)https?://[^\\t\\n\\v\\f\\r <>"'']+'), lambda x: lower(regexp_replace(x, '{TAIL}', '')))) as url from messages),
    h as (select id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host from u)
    select id, url, host, regexp_matches(host, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') as is_ip, starts_with(url, 'https:') as is_https, length(url) as length from h""",
)
def url_parse(spark, d):
    web = F.filter(X.urls(F.col("body")), lambda u: u.rlike("(?i)^https?://"))
    rows = _messages(spark, d, "body").select("id", F.explode(web).alias("u")).select("id", X.url_parts(F.col("u")).alias("p"))
    return rows.select("id", F.col("p.analysis_url").alias("url"), "p.host", "p.is_ip", "p.is_https", F.col("p.length").cast("bigint").alias("length"))


# ---------------------------------------------------------------- linkage

_FULL = "trim(concat_ws(' ', coalesce(sender,''), coalesce(receiver,''), coalesce(date,''), coalesce(subject,''), coalesce(body,'')))"


def _sides(spark, d):
    m = _messages(spark, d, "sender", "receiver", "date", "subject", "body", "language", "parent_id")
    m = m.withColumn("text", K.full_text(*[F.col(c) for c in ("sender", "receiver", "date", "subject", "body")]))
    left = m.filter("language = 'en' and coalesce(parent_id,'') = ''")
    right = m.filter("language = 'vi'")
    text = F.col("text")
    sides = K.subject_evidence(K.evidence(left, text), text, F.col("subject")), K.subject_evidence(K.evidence(right, text), text)
    return tuple(cut(s.select("id", *K.FIELDS, "subject_tokens", "n_chars")) for s in sides)


@query(
    "number_frequency",
    rf"select value, count(*) as df from (select distinct id, unnest(string_split(regexp_replace({_FULL}, '[^\pL\pN\pM_]+', ' ', 'g'), ' ')) as value from messages where language = 'en' and coalesce(parent_id,'') = '') where regexp_full_match(value, '\p{{Nd}}{{2,}}') group by 1",
)
def number_frequency(spark, d):
    left, _ = _sides(spark, d)
    return K.document_frequency(left, ("numbers",)).select("value", "df")


@query("blocking_candidates")
def blocking_candidates(spark, d):
    """All five fields over sender, receiver, date, subject and body."""
    return K.candidates(*_sides(spark, d)).groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n_shared"))


@query("link_topk")
def link_topk(spark, d):
    left, right = _sides(spark, d)
    top = K.ranked(K.overlap_scored(K.candidates(left, right), left, right))
    return top.select("left_id", "right_id", "points", "score", "n_types", F.col("candidate_rank").cast("bigint").alias("candidate_rank"), "margin")


@query("single_links", "select vietnamese_id as right_id, min(english_id) as left_id from cross_language_overlap where vietnamese_id is not null and lower(trim(review_status)) = 'confirmed' group by 1 having count(distinct english_id) = 1")
def single_links(spark, d):
    o = table(spark, d, "cross_language_overlap").filter("vietnamese_id is not null and lower(trim(review_status)) = 'confirmed'")
    return K.single_links(o.select(F.col("english_id").alias("left_id"), F.col("vietnamese_id").alias("right_id")))


@query(
    "link_groups",
    """with k as (select english_id as l, vietnamese_id as r, 'xlang_' || substring(sha256(english_id || '|' || vietnamese_id), 1, 20) as g from cross_language_overlap where lower(trim(review_status)) = 'confirmed' and english_id is not null and vietnamese_id is not null),
    n as (select id, min(g) as g from (select l as id, g from k union all select r, g from k) group by 1) select m.id, coalesce(n.g, m.group_id) as cross_group from messages m left join n using (id)""",
)
def link_groups(spark, d):
    o = table(spark, d, "cross_language_overlap").filter("lower(trim(review_status)) = 'confirmed' and english_id is not null and vietnamese_id is not null")
    links = o.select(F.col("english_id").alias("left_id"), F.col("vietnamese_id").alias("right_id"))
    m = _messages(spark, d, "group_id")
    return K.shared_groups(links, m, m.limit(0))


@query(
    "link_status",
    """with b as (select vietnamese_id as id, min(case confidence when 'high' then 0 when 'medium' then 1 else 2 end) as best from cross_language_overlap where vietnamese_id is not null group by 1)
    select case best when 0 then 'high' when 1 then 'medium' else 'uncertain' end as best_status, count(*) as n_ids from b group by 1""",
)
def link_status(spark, d):
    o = table(spark, d, "cross_language_overlap").filter("vietnamese_id is not null")
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    best = o.groupBy("vietnamese_id").agg(F.min(rank).alias("best"))
    name = F.when(F.col("best") == 0, "high").when(F.col("best") == 1, "medium").otherwise("uncertain")
    return best.groupBy(name.alias("best_status")).agg(F.count(F.lit(1)).alias("n_ids"))


# ---------------------------------------------------------------- metrics

LABELS = ("normal", "spam", "phishing")
_PRED = """(select m.id, lower(trim(label)) as t, case raw_label when '1' then case when url_count > 0 then 'phishing' else 'spam' end when '0' then 'normal' else 'normal' end as p, source as scope from messages m where lower(trim(label)) in ('normal','spam','phishing') and source is not null)"""
_PER = f"""with c as (select {{scope}} as scope, l.label, sum((t = l.label)::int)::bigint as support, sum((p = l.label)::int)::bigint as predicted, sum((t = l.label and p = l.label)::int)::bigint as hits from {_PRED} x join (values ('normal'),('spam'),('phishing')) l(label) on true group by all),
    q as (select *, case when support = 0 then null when predicted = 0 then 0.0 else hits/predicted end as precision, case when support = 0 then null else hits/support end as recall from c),
    f as (select *, case when support = 0 then null when precision + recall = 0 then 0.0 else 2*precision*recall/(precision+recall) end as f1 from q)"""


def _predicted(spark, d):
    m = _messages(spark, d, "label", "raw_label", "url_count", "source")
    p = F.when(F.col("raw_label") == "1", F.when(F.col("url_count") > 0, "phishing").otherwise("spam")).otherwise("normal")
    rows = m.select("id", F.lower(F.trim("label")).alias("t"), p.alias("p"), F.col("source").alias("scope"))
    return rows.filter(F.col("t").isin(*LABELS) & F.col("scope").isNotNull())


@query("confusion_matrix", f"select t, p, count(*) as n from {_PRED} group by all")
def confusion_matrix(spark, d):
    return M.confusion(_predicted(spark, d), "t", "p")


@query("class_metrics", _PER.format(scope="'all'") + " select scope, label, support, predicted, hits, round(precision,9)::double as precision, round(recall,9)::double as recall, round(f1,9)::double as f1 from f")
def class_metrics(spark, d):
    per = M.class_metrics(_predicted(spark, d), "t", "p", LABELS)
    return per.select("scope", "label", "support", "predicted", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "subset_metrics",
    _PER.format(scope="scope") + """ select scope, sum(support)::bigint as n_rows, round(sum(hits)/sum(support),9) as accuracy, round(avg(precision),9) as macro_precision, round(avg(recall),9) as macro_recall, round(avg(f1),9) as macro_f1,
    round(sum(coalesce(f1,0)*support)/sum(support),9) as weighted_f1, case when sum((support>0)::int) = 3 then round(avg(f1),9) end as full_macro_f1 from f group by scope""",
)
def subset_metrics(spark, d):
    out = M.scope_metrics(M.class_metrics(_predicted(spark, d), "t", "p", LABELS, "scope"), LABELS)
    return out.select("scope", "n_rows", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


_REPORT = _PER.format(scope="scope") + """, s as (select scope, sum(support)::bigint as n_rows, sum(hits)/sum(support) as accuracy, avg(f1) as f1 from f group by scope)"""


@query(
    "metrics_report",
    _REPORT + """ select scope, 'scope_summary' as row_type, null as label, n_rows, round(f1, 9)::double as f1, round(accuracy, 9)::double as accuracy from s
    union all select scope, 'class_metric', label, support, round(f1, 9)::double, null from f""",
)
def metrics_report(spark, d):
    per = M.class_metrics(_predicted(spark, d), "t", "p", LABELS, "scope")
    out = M.report_rows(per, M.scope_metrics(per, LABELS))
    return out.select("scope", "row_type", "label", "n_rows", F.round("f1", 9).alias("f1"), F.round("accuracy", 9).alias("accuracy"))


@query(
    "wide_metrics",
    _PER.format(scope="scope") + " select scope, " + ", ".join(f"round(max(case when label = '{x}' then {c} end), 9)::double as {x}_{c}" for x in ("normal", "spam", "phishing") for c in ("precision", "recall", "f1")) + " from f group by scope",
)
def wide_metrics(spark, d):
    out = M.wide_rows(M.class_metrics(_predicted(spark, d), "t", "p", LABELS, "scope"), LABELS)
    return out.select("scope", *[F.round(c, 9).alias(c) for c in out.columns if c != "scope"])


@query(
    "comparison_rows",
    _REPORT + """, n as (select scope, recall from f where label = 'normal') select s.scope, round(s.f1, 9)::double as macro_f1, round(1 - n.recall, 9)::double as normal_false_positive_rate,
    round(s.f1 - (select f1 from s where scope = (select min(scope) from s)), 9)::double as delta_macro_f1 from s left join n using (scope)""",
)
def comparison_rows(spark, d):
    per = cut(M.class_metrics(_predicted(spark, d), "t", "p", LABELS, "scope"))
    first = per.agg(F.min("scope").alias("s")).first()["s"]
    out = M.comparison_rows(per, LABELS, first)
    return out.select("scope", *[F.round(c, 9).alias(c) for c in out.columns if c != "scope"])


@query("summed_distribution", "select label as value, sum(n)::bigint as n_rows, count(distinct split) as n_splits from (select split, label, count(*) as n from messages where label is not null and split is not null group by all) group by 1")
def summed_distribution(spark, d):
    m = _messages(spark, d, "label", "split").filter("label is not null and split is not null")
    return A.summed_distribution(m, "split", "label")


@query(
    "policy_availability",
    """select source, count(*) filter (where lower(trim(label_status)) = 'review') as review, count(*) filter (where lower(trim(label_status)) = 'eligible') as eligible, count(*) filter (where coalesce(lower(trim(label_status)), '') not in ('review','eligible')) as other, count(*) as n_rows from messages group by 1""",
)
def policy_availability(spark, d):
    return A.availability(_messages(spark, d, "source", "label_status"), "source", F.lower(F.trim("label_status")), ["review", "eligible"])


@query("split_crosstabs", " union all ".join(f"select split, '{c}' as dimension, case when trim(coalesce({c},'')) = '' then 'not_declared' else {c} end as value, count(*) as n_rows from messages where split is not null group by all" for c in ("label", "language", "data_origin", "source")))
def split_crosstabs(spark, d):
    m = _messages(spark, d, "split", "label", "language", "data_origin", "source").filter("split is not null")
    return A.long_crosstabs(m, "split", ["label", "language", "data_origin", "source"])


@query(
    "rank_experiments",
    """with r as (select phien_ban_mo_hinh as run_id, round(avg(do_tin_cay),6) as macro_f1, round(avg(case when nhan_du_doan = 'phishing' then 1.0 else 0.0 end),6) as phishing_recall, round(abs(avg(case when ngon_ngu_phat_hien = 'en' then do_tin_cay end) - avg(case when ngon_ngu_phat_hien = 'vi' then do_tin_cay end)),6) as language_gap, round(avg(co_canh_bao),6) as false_alarms from phan_tich_thu where phien_ban_mo_hinh is not null group by 1)
    select run_id, macro_f1, row_number() over (order by macro_f1 desc nulls last, phishing_recall desc nulls last, language_gap asc nulls last, false_alarms asc nulls last, run_id) as rank, row_number() over (order by macro_f1 desc nulls last, phishing_recall desc nulls last, language_gap asc nulls last, false_alarms asc nulls last, run_id) = 1 as selected from r""",
)
def rank_experiments(spark, d):
    a = table(spark, d, "phan_tich_thu").filter("phien_ban_mo_hinh is not null")
    mean = lambda c: F.round(F.avg(c), 6)
    lang = lambda x: F.avg(F.when(F.col("ngon_ngu_phat_hien") == x, F.col("do_tin_cay")))
    runs = a.groupBy(F.col("phien_ban_mo_hinh").alias("run_id")).agg(
        mean("do_tin_cay").alias("macro_f1"), mean(F.when(F.col("nhan_du_doan") == "phishing", 1.0).otherwise(0.0)).alias("phishing_recall"),
        F.round(F.abs(lang("en") - lang("vi")), 6).alias("language_gap"), mean("co_canh_bao").alias("false_alarms"),
    )
    return M.rank_experiments(runs).select("run_id", "macro_f1", F.col("rank").cast("bigint").alias("rank"), "selected")


@query(
    "scopes_by_grouping_sets",
    f"""with x as (select label, language, case when n < 50 then 'short' when n <= 150 then 'medium' else 'long' end as bucket from (select label, language, len(regexp_extract_all({BODY}, '[^\\t\\n\\f\\r\\v ]+')) as n from messages where label in ('normal','spam','phishing') and language in ('en','vi')))
    select case grouping_id(bucket, label, language) when 7 then 'overall' when 5 then 'label' when 6 then 'language' when 3 then 'bucket' else 'language_label' end as scope, bucket, label, language, count(*) as n_rows from x group by grouping sets ((), (label), (language), (bucket), (language, label))""",
)
def scopes_by_grouping_sets(spark, d):
    m = _messages(spark, d, "label", "language", "body").filter("label in ('normal','spam','phishing') and language in ('en','vi')")
    rows = m.select("label", "language", T.length_bucket(T.token_count(F.col("body"))).alias("bucket"))
    sets = {"overall": [], "label": ["label"], "language": ["language"], "bucket": ["bucket"], "language_label": ["language", "label"]}
    return M.overlapping_scopes(rows, [F.count(F.lit(1)).alias("n_rows")], sets)


@query("tag_counts", "select trim(tag) as tag, count(*) as n from (select unnest(string_split(coalesce(cc,''), ',')) as tag from thu) where trim(tag) <> '' group by 1")
def tag_counts(spark, d):
    return M.tag_counts(table(spark, d, "thu"), "cc", ",")


# ---------------------------------------------------------------- audits


@query(
    "column_profile",
    "select 'label' as \"column\", 'string' as dtype, count(*) as n_rows, count(label) as non_null, round(100*(count(*)-count(label))/count(*),6) as missing_percent, count(distinct label) as n_distinct from messages"
    + "".join(
        f" union all select '{c}', '{k}', count(*), count({c}), round(100*(count(*)-count({c}))/count(*),6), count(distinct {c}) from messages"
        for c, k in (("source", "string"), ("language", "string"), ("content_hash", "string"), ("group_id", "string"), ("url_count", "int"), ("training_eligible", "boolean"))
    ),
)
def column_profile(spark, d):
    return A.column_profile(table(spark, d, "messages", ("label", "source", "language", "content_hash", "group_id", "url_count", "training_eligible")))


@query("sample_values", "select distinct source as value from messages where source is not null order by value limit 5")
def sample_values(spark, d):
    """Five sample values: the limit is the feature."""
    return A.sample_values(table(spark, d, "messages", ("source",)), "source")


@query(
    "table_profile",
    """with r as (select id_thu, thu_muc_cu, thu_muc_moi, ly_do, count(*) as n from (select id_thu, thu_muc_cu, thu_muc_moi, ly_do from lich_su_thu_muc) group by all), t as (select ly_do, count(*) as n from lich_su_thu_muc group by all)
    select 4 as n_columns, (select sum(n)::bigint from r) as n_rows, (select sum((thu_muc_cu is null)::int + (thu_muc_moi is null)::int + (ly_do is null)::int + (id_thu is null)::int)::bigint from lich_su_thu_muc) as missing_cells,
    (select coalesce(sum(n) filter (where n > 1),0)::bigint from r) as repeated_rows, (select coalesce(sum(n) filter (where n > 1),0)::bigint from t) as repeated_contents, (select count(*) from t) as distinct_contents""",
)
def table_profile(spark, d):
    return A.table_profile(table(spark, d, "lich_su_thu_muc", ("id_thu", "thu_muc_cu", "thu_muc_moi", "ly_do")), ["ly_do"])


@query(
    "length_stats",
    f"""select coalesce(source,'(none)') as scope, count(*) as n_rows, min(n) as shortest, round(quantile_cont(n,0.25),6) as p25, round(quantile_cont(n,0.5),6) as median, round(avg(n),6) as mean, round(quantile_cont(n,0.75),6) as p75, round(quantile_cont(n,0.95),6) as p95, max(n) as longest,
    round(quantile_cont(w,0.5),6) as median_words, round(avg(w),6) as mean_words from (select source, length({BODY}) as n, len(regexp_extract_all({BODY}, '[^\\t\\n\\f\\r\\v ]+')) as w from messages) group by 1""",
)
def length_stats(spark, d):
    return A.length_stats(_messages(spark, d, "source", "body"), F.coalesce("body", F.lit("")), "source")


@query("pattern_counts", f"select unnest(['page','amount','code','any']) as pattern, unnest([sum(a)::bigint, sum(b)::bigint, sum(c)::bigint, sum(greatest(a,b,c))::bigint]) as n_rows from (select regexp_matches({BODY}, 'https?://')::int as a, regexp_matches({BODY}, 'USD|đồng|EUR|dollars')::int as b, regexp_matches({BODY}, '[A-Z]{{2,3}}-[0-9]{{5,}}')::int as c from messages)")
def pattern_counts(spark, d):
    return A.pattern_counts(_messages(spark, d, "body"), F.coalesce("body", F.lit("")), {"page": "https?://", "amount": "USD|đồng|EUR|dollars", "code": "[A-Z]{2,3}-[0-9]{5,}"})


@query("label_distribution", "select case when label is null or trim(label) = '' then 'not_declared' else label end as value, count(*) as n_rows, round(100*count(*)/sum(count(*)) over (), 6) as percent from messages group by 1")
def label_distribution(spark, d):
    return A.distribution(_messages(spark, d, "label"), F.col("label"))


@query("source_label_crosstab", "select source, count(*) filter (where label = 'normal') as normal, count(*) filter (where label = 'spam') as spam, count(*) filter (where label = 'phishing') as phishing from messages group by 1")
def source_label_crosstab(spark, d):
    return A.crosstab(_messages(spark, d, "source", "label"), "source", "label", ["normal", "spam", "phishing"])


@query(
    "split_summary",
    "select m.split, count(*) as n_rows, count(distinct group_id) as n_groups, round(count(*)/sum(count(*)) over (), 8) as share, round(100*(round(count(*)/sum(count(*)) over (), 8) - any_value(ratio)), 6) as deviation_points from messages m join split_targets s on m.split = s.split group by 1",
)
def split_summary(spark, d):
    m = _messages(spark, d, "split", "group_id").filter("split in ('train','validation','test')")
    return A.split_summary(m, "split", F.col("group_id"), table(spark, d, "split_targets"))


@query("phrase_hits", f"select id, least(case when contains({BODY}, 'loyalty card') then 'loyalty card' end, case when contains({BODY}, 'password') then 'password' end, case when contains({BODY}, 'warranty card') then 'warranty card' end) as first_phrase, (contains({BODY}, 'loyalty card')::int + contains({BODY}, 'password')::int + contains({BODY}, 'warranty card')::int) as n_phrases from messages where contains({BODY}, 'loyalty card') or contains({BODY}, 'password') or contains({BODY}, 'warranty card')")
def phrase_hits(spark, d):
    return A.phrase_hits(_messages(spark, d, "body"), ["password", "loyalty card", "warranty card"], "body")


@query("unicode_stats", f"select count(*) as n_rows, count(*) filter (where nfc_normalize({BODY}) <> {BODY}) as not_nfc, count(*) filter (where contains({BODY}, chr(65533))) as replacement_marks, count(*) filter (where not regexp_matches({BODY}, '[^\\x00-\\x7f]')) as ascii_only from messages")
def unicode_stats(spark, d):
    b = F.coalesce("body", F.lit(""))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    m = _messages(spark, d, "body").select(b.alias("b"), T.is_nfc(b).alias("nfc"))
    return m.agg(F.count(F.lit(1)).alias("n_rows"), n(~F.col("nfc"))("not_nfc"), n(F.contains("b", F.lit("�")))("replacement_marks"), n(F.length("b") == F.octet_length("b"))("ascii_only"))


@query("origin_counts", "select case when trim(coalesce(data_origin,'')) <> '' then data_origin when language = 'en' then 'original_english' else 'unspecified' end as origin, count(*) as n_rows from messages group by 1")
def origin_counts(spark, d):
    o = F.when(F.trim(F.coalesce("data_origin", F.lit(""))) != "", F.col("data_origin")).when(F.col("language") == "en", "original_english").otherwise("unspecified")
    return _messages(spark, d, "data_origin", "language").groupBy(o.alias("origin")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("label_set_difference", "select label as value, 'unexpected' as side from (select distinct label from messages where label is not null except select * from (values ('normal'),('spam'),('phishing'),('ham'))) union all select v, 'unused' from (select * from (values ('normal'),('spam'),('phishing'),('ham')) x(v) except select distinct label from messages)")
def label_set_difference(spark, d):
    seen = _messages(spark, d, "label").select(F.col("label").alias("value")).filter("value is not null").distinct()
    wanted = spark.createDataFrame([(x,) for x in ("normal", "spam", "phishing", "ham")], "value string")
    return seen.exceptAll(wanted).withColumn("side", F.lit("unexpected")).unionByName(wanted.exceptAll(seen).withColumn("side", F.lit("unused")))


QUERIES, SQL = query.queries, query.sql
