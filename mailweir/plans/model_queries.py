"""Queries on features, models, allocation and robustness."""

from __future__ import annotations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from mailweir.operators import features, robustness
from mailweir.plans.registry import Registry
from mailweir.session import spread
from mailweir.sources.tables import table

query = Registry()

_TERMS = """(select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) as term from (select id, regexp_extract_all(lower(coalesce(subject,'') || chr(10) || coalesce(body,'')), '[\\pL\\pN_]{2,}') as w from messages))"""
_TFIDF = f"""with tf as (select id, term, count(*) as c from {_TERMS} group by all), df as (select term, count(*) as df from tf group by 1 having count(*) >= 2),
    w as (select id, term, (1 + ln(c)) * (ln((1.0 + (select count(*) from messages)) / (1.0 + df)) + 1) as w from tf join df using (term)),
    x as (select id, term, w / sqrt(sum(w*w) over (partition by id)) as weight from w)"""


def _text(spark, d, *columns):
    m = table(spark, d, "messages", ("id", "subject", "body", *columns))
    return m.select("id", features.message_text(F.col("subject"), F.col("body")).alias("text"), *columns)


def _text_weights(spark, d):
    return features.tfidf(_text(spark, d), features.word_terms(F.col("text"), features.ANY_WORD))


def _labels(spark, d):
    return table(spark, d, "messages", ("id", "label")).select("id", F.lower(F.trim("label")).alias("label")).filter("label in ('normal','spam','phishing')")


@query("tfidf_weights", _TFIDF + " select id, term, round(weight, 8) as weight from x")
def tfidf_weights(spark, d):
    return _text_weights(spark, d).select("id", "term", F.round("weight", 8).alias("weight"))


@query(
    "tfidf_class_terms",
    _TFIDF + """, l as (select id, lower(trim(label)) as label from messages where lower(trim(label)) in ('normal','spam','phishing')), n as (select label, count(*) as n from l group by 1),
    b as (select term, label, sum(weight) as s from x join l using (id) group by all), t as (select term, sum(weight) as a from x join l using (id) group by 1)
    select term, label, round(s/n - (a-s)/((select count(*) from l)-n), 8) as coefficient from b join t using (term) join n using (label)""",
)
def tfidf_class_terms(spark, d):
    labels = table(spark, d, "messages", ("id", "label")).select("id", F.lower(F.trim("label")).alias("label")).filter("label in ('normal','spam','phishing')")
    return features.class_coefficients(_text_weights(spark, d), labels).select("term", "label", F.round("coefficient", 8).alias("coefficient"))


@query("top_contributions")
def top_contributions(spark, d):
    """The five strongest terms a text and label: the limit is the feature."""
    w = _text_weights(spark, d)
    coefficients = features.class_coefficients(w, _labels(spark, d))
    return features.contributions(w, coefficients, n_docs=table(spark, d, "messages", ("id",)).count())


@query("char_ngrams")
def char_ngrams(spark, d):
    """3- to 5-grams of subject and body."""
    return spread(_text(spark, d)).select(F.explode(features.char_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "embedding_neighbours",
    """with u as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y*y)))) as e from u),
    s as (select q.vec_id as query_id, b.vec_id, list_inner_product(q.e, b.e) as cosine from n q join n b on q.vec_id <> b.vec_id where q.vec_id % 50 = 0)
    select query_id, vec_id, round(cosine, 6) as cosine, rank from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from s) where rank <= 10""",
)
def embedding_neighbours(spark, d):
    """Ten nearest of every query vector (ids divisible by 50) among all vectors."""
    e = table(spark, d, "embeddings", ("vec_id", "embedding"))
    out = features.nearest(e.filter("vec_id % 50 = 0"), e, 10)
    return out.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def _trained(spark, d, kind):
    m = spread(table(spark, d, "messages", ("id", "subject", "body", "label", "group_id")))
    rows = m.select("id", features.message_text(F.col("subject"), F.col("body")).alias("text"), F.lower(F.trim("label")).alias("label"), F.coalesce("group_id", "id").alias("grp"))
    folds = features.group_folds(rows.filter("label in ('normal','spam','phishing')"), "grp")
    model = features.text_pipeline(kind, vocabulary=5000).fit(features.balanced(folds.filter("fold <> 0")))
    return model.transform(folds.filter("fold = 0").withColumn("weight", F.lit(1.0)))


def _scores(scored):
    hit = F.avg((F.col("prediction") == F.col("y")).cast("double"))
    f1 = MulticlassClassificationEvaluator(labelCol="y", predictionCol="prediction", metricName="f1").evaluate(scored)
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), hit.alias("accuracy")).withColumn("weighted_f1", F.lit(f1))


@query("model_naive_bayes")
def model_naive_bayes(spark, d):
    return _scores(_trained(spark, d, "naive_bayes"))


@query("model_logistic")
def model_logistic(spark, d):
    return _scores(_trained(spark, d, "logistic"))


@query("model_linear_svc")
def model_linear_svc(spark, d):
    return _scores(_trained(spark, d, "linear_svc"))


@query("robust_variants", "select id as parent_id, 'spacing' as variant, replace(coalesce(body,''), ' ', '  ') as text from messages where label = 'phishing' union all select id, 'punctuation', replace(coalesce(body,''), '.', '!!') || ' ...' from messages where label = 'phishing' union all select id, 'clean', coalesce(body,'') from messages where label = 'phishing'")
def robust_variants(spark, d):
    m = table(spark, d, "messages", ("id", "body", "label")).filter("label = 'phishing'")
    return robustness.variants(m).filter("variant in ('spacing','punctuation','clean')").select("parent_id", "variant", "text")


@query("robust_all_variants")
def robust_all_variants(spark, d):
    return robustness.variants(table(spark, d, "messages", ("id", "body")))


@query(
    "variant_measures",
    """with r as (select id_thu, case phien_ban_mo_hinh when (select min(phien_ban_mo_hinh) from phan_tich_thu) then 'clean' else phien_ban_mo_hinh end as variant, min(nhan_du_doan) as prediction, round(avg(do_tin_cay),6) as confidence, round(avg(diem_rui_ro),6) as risk from phan_tich_thu where phien_ban_mo_hinh is not null group by all),
    c as (select r.*, r.prediction <> b.prediction as flipped, b.confidence - r.confidence as confidence_drop, r.risk - b.risk as risk_change from r left join r b on r.id_thu = b.id_thu and b.variant = 'clean'),
    s as (select variant as scope, * from c union all select 'all_transformed', * from c where variant <> 'clean')
    select scope, count(*) as n_rows, round(avg(flipped::double),6) as flip_rate, round(avg(confidence),6) as mean_confidence, round(avg(confidence_drop),6) as mean_drop, round(avg(risk_change),6) as mean_risk_change from s group by 1""",
)
def variant_measures(spark, d):
    a = table(spark, d, "phan_tich_thu").filter("phien_ban_mo_hinh is not null")
    first = a.agg(F.min("phien_ban_mo_hinh").alias("v")).first()["v"]
    v = F.when(F.col("phien_ban_mo_hinh") == first, "clean").otherwise(F.col("phien_ban_mo_hinh"))
    r = a.groupBy(F.col("id_thu").alias("parent_id"), v.alias("variant")).agg(F.min("nhan_du_doan").alias("prediction"), F.round(F.avg("do_tin_cay"), 6).alias("confidence"), F.round(F.avg("diem_rui_ro"), 6).alias("risk"))
    out = robustness.variant_measures(robustness.against_clean(r))
    return out.select("scope", "n_rows", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


QUERIES, SQL = query.queries, query.sql
