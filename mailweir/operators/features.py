"""Text features and models: TF-IDF weights by joins, n-grams, cosine search in blocks, linear models, explanations."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailweir.session import cut


def message_text(subject: Column, body: Column) -> Column:
    return F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


ASCII_WORD, ANY_WORD = "[a-z0-9]{2,}", r"[\p{L}\p{N}_]{2,}"


def word_terms(text: Column, word: str = ASCII_WORD) -> Column:
    """Words of two or more characters (``word``: of ASCII or any letters) and their pairs."""
    w = F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))
    n = F.size(w)
    two = F.when(n > 1, F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, two)


def char_terms(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with one blank on each side."""
    w = F.transform(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def grams(n: int) -> Column:
        return F.flatten(F.transform(F.filter(w, lambda x: F.length(x) >= n), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substr(x, i, F.lit(n)))))

    return F.concat(*[grams(n) for n in range(low, high + 1)])


#: Texts of one task; their counts are kept in memory. Terms of fewer texts than one in ``RARE`` are joined by a shuffle.
TEXTS_A_TASK, RARE = 8192, 16384


def _tasks(df: DataFrame, n_docs: int) -> int:
    """Partitions by text, the same number for all that is joined by text."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n_docs // TEXTS_A_TASK))


def _by_term(rows: DataFrame, per_term: DataFrame, n: str, n_docs: int, minimum: int = 0) -> DataFrame:
    """Inner join of ``rows``, partitioned by id, with rows per term, partitioned by id again.

    Terms that one text in ``RARE`` holds (count ``n``) are most of all rows and few in number (at most ``RARE`` times the
    mean number of terms in a text): they are broadcast, so that their rows stay where they are. Only rows of rarer terms
    are shuffled, to their terms and back.
    """
    limit, parts = max(minimum, n_docs // RARE), _tasks(rows, n_docs)
    often = F.broadcast(per_term.filter(F.col(n) >= limit))
    rare = rows.join(F.broadcast(per_term.filter(F.col(n) >= limit).select("term").distinct()), "term", "left_anti")
    rare = rare.join(per_term.filter(F.col(n) < limit), "term")
    return rows.join(often, "term").unionByName(rare.repartition(parts, "id"))


def tfidf(df: DataFrame, terms: Column, id_col: str = "id", min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """(id, term, weight): sublinear counts, smoothed inverse frequency, unit length; terms in fewer texts are dropped.

    ``max_features`` keeps the terms of highest total count (ties by term). Texts are shuffled once, by id; their terms
    are counted and weighed there, and never shuffled but for the rare ones.
    """
    n_docs = df.count()
    docs = df.repartition(_tasks(df, n_docs), id_col).select(F.col(id_col).alias("id"), F.explode(terms).alias("term"))
    tf = docs.groupBy("id", "term").agg(F.count(F.lit(1)).alias("c"))
    if max_features or not df.groupBy(id_col).count().filter("count > 1").isEmpty():
        df_t = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("total"))
    else:  # a text of each id: its terms are counted where it is read
        df_t = df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df_t = df_t.filter(F.col("df") >= min_df)
    if max_features:
        df_t = df_t.orderBy(F.col("total").desc(), "term").limit(max_features)
    df_t = cut(df_t.select("term", "df"))
    idf = F.log((F.lit(1.0) + n_docs) / (1.0 + F.col("df"))) + 1.0
    w = _by_term(tf, df_t, "df", n_docs, min_df).select("id", "term", ((1.0 + F.log("c")) * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "term", (F.col("w") / norm).alias("weight"))


def contributions(weights: DataFrame, coefficients: DataFrame, k: int = 5, n_docs: int = 0) -> DataFrame:
    """(id, label, term, contribution, rank): strongest positive terms of a linear model for each text and label.

    With ``n_docs``, their number, texts stay where ``tfidf`` put them; coefficients then have the count ``n_texts``.
    """
    c = (_by_term(weights, coefficients, "n_texts", n_docs) if n_docs else weights.join(coefficients, "term")).withColumn("contribution", F.col("weight") * F.col("coefficient"))
    c = c.filter((F.col("contribution") > 0) & ~F.col("term").rlike("^[0-9 ]*$"))
    w = Window.partitionBy("id", "label").orderBy(F.col("contribution").desc(), "term")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "label", "term", "contribution", "rank")


def class_coefficients(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, label, coefficient, n_texts): mean weight of a term inside a label less its mean outside; labelled texts
    that hold the term."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = labels.agg(F.count(F.lit(1)).alias("whole")).first()["whole"]
    by = weights.join(labels, "id").groupBy("term", "label").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("m"))
    term = Window.partitionBy("term")  # at most a row a label
    j = by.withColumns({"all": F.sum("s").over(term), "n_texts": F.sum("m").over(term)}).join(F.broadcast(n), "label")  # one row a label
    return j.select("term", "label", (F.col("s") / F.col("n") - (F.col("all") - F.col("s")) / (F.lit(whole) - F.col("n"))).alias("coefficient"), "n_texts")


def unit(col: Column) -> Column:
    v = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / norm)


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", per_block: int = 1000) -> DataFrame:
    """(query_id, vec_id, cosine, rank): exact ``k`` nearest of a stated query set against all rows, block by block.

    The query set is cut into blocks of about ``per_block`` vectors; every row meets every block once. Each query keeps
    its ``k`` best of each of 64 slices of the rows before these meet, so no task ranks all rows of a query.
    """
    blocks = max(1, -(-queries.count() // per_block))
    q = queries.select(F.col(id_col).alias("query_id"), unit(F.col(vector)).alias("q")).groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("bigint").alias("qb"))
    q = q.agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))  # one block of the query set
    b = base.select(F.col(id_col), unit(F.col(vector)).alias("v"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("qb"))
    pairs = b.join(q, "qb").select(id_col, "v", F.explode("qs").alias("x")).filter(F.col("x.query_id") != F.col(id_col))
    scored = pairs.select("x.query_id", F.col(id_col), cosine(F.col("x.q"), F.col("v")).alias("cosine"))
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64(id_col), F.lit(64))).orderBy(F.col("cosine").desc(), id_col)
    best = scored.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k).drop("r")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), id_col)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def classifier(kind: str):
    """The three kinds of linear model over term counts or weights."""
    if kind == "naive_bayes":
        return NaiveBayes(featuresCol="features", labelCol="y", weightCol="weight")
    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=30, regParam=0.01)
    if kind == "linear_svc":
        return OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01), featuresCol="features", labelCol="y", weightCol="weight")
    raise ValueError(f"unknown classifier {kind}")


def text_pipeline(kind: str, vocabulary: int = 20000, min_df: int = 2) -> Pipeline:
    """text -> words and pairs -> counts -> label index -> model. Expects columns text, label, weight."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
            NGram(n=2, inputCol="w1", outputCol="w2"),
            SQLTransformer(statement="SELECT *, concat(w1, w2) AS terms FROM __THIS__"),
            CountVectorizer(inputCol="terms", outputCol="features", vocabSize=vocabulary, minDF=min_df),
            StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc"),
            classifier(kind),
        ]
    )


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with weights that give every label the same sum."""
    n = F.count(F.lit(1))
    per = df.groupBy(label).agg(n.alias("_n"))
    stats = per.agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    return df.join(F.broadcast(per), label).withColumn("weight", F.lit(float(stats["t"])) / (F.lit(stats["k"]) * F.col("_n"))).drop("_n")  # one row a label


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """``df`` with a fold per group, by hash: no group stands in two folds."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(group)), F.lit(k)).cast("int"))


def calibrated(scored: DataFrame, margins: dict[str, str], label: str = "label") -> DataFrame:
    """``scored`` with ``p_<label>`` columns that sum to one: a sigmoid fitted to each label's margin column.

    The margins should come from folds in which the rows took no part (see ``group_folds``).
    """
    for name, column in margins.items():
        rows = scored.select(F.col(column).cast("double").alias("m"), (F.col(label) == name).cast("double").alias("hit"))
        rows = VectorAssembler(inputCols=["m"], outputCol="v").transform(rows)
        fitted = LogisticRegression(featuresCol="v", labelCol="hit", standardization=False).fit(rows)
        scored = scored.withColumn(f"p_{name}", 1.0 / (1.0 + F.exp(-(F.col(column) * float(fitted.coefficients[0]) + float(fitted.intercept)))))
    total = sum((F.col(f"p_{n}") for n in margins), F.lit(0.0))
    return scored.withColumns({f"p_{n}": F.col(f"p_{n}") / total for n in margins})


def probability_violations(df: DataFrame, columns: list[str], tolerance: float = 1e-7) -> DataFrame:
    """Rows whose probabilities are no numbers in [0, 1] that sum to one."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    bad = F.abs(total - 1.0) > tolerance
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)
    return df.filter(bad)


