"""Splits that keep related records together (problem 7): grouped iterative stratification.

Components of records tied by group or parent are found, their label vectors summed, and components placed: the
label with the fewest outstanding records goes first, each of its components into the split that needs it most.

What is placed on the driver is bounded for any input. Components of at least one part in ``BIG`` of all rows (at most
``BIG`` exist) are placed one by one, largest first. All others are placed by class: components of equal label vector
(up to ``EXACT`` rows) or of equal coarse vector (larger ones) are interchangeable, and the classes are few. A class
gets a number of components per split; the components take it by their rank in a hash order, counted in buckets so
that a class that holds half of all rows is ranked by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailweir.llm.components import message_components
from mailweir.operators.standardize import LABELS, label_class
from mailweir.session import cut

BIG = 2000
EXACT = 6
BUCKETS = 256
@dataclass
class Item:
    key: str
    count: int
    vector: list[float]
    share: list[int] | None = None


def place(items: list[Item], ratios: list[float]) -> None:
    """Fill ``share`` (components per split) of every item."""
    width = len(items[0].vector) if items else 0
    total = [sum(i.vector[k] * i.count for i in items) for k in range(width)]
    want = [[r * t for t in total] for r in ratios]
    room = [r * sum(total) for r in ratios]
    open_items = sorted(items, key=lambda i: (-sum(i.vector), i.key))
    while open_items:
        left = [sum(i.vector[k] * i.count for i in open_items) for k in range(width)]
        k = min((x for x in range(width) if left[x] > 0), key=lambda x: left[x])
        for item in [i for i in open_items if i.vector[k] > 0]:
            size = sum(item.vector)
            item.share = [0] * len(ratios)
            rest = item.count
            if rest > len(ratios):
                need = [max(0.0, w[k]) for w in want]
                need = need if sum(need) > 0 else [max(0.0, x) for x in room]
                need = need if sum(need) > 0 else list(ratios)
                bulk = [int(rest * n / sum(need)) for n in need]
                for s, n in enumerate(bulk):
                    item.share[s] += n
                    room[s] -= n * size
                    for j in range(width):
                        want[s][j] -= n * item.vector[j]
                rest -= sum(bulk)
            for _ in range(rest):
                s = max(range(len(ratios)), key=lambda x: (want[x][k], room[x], -x))
                item.share[s] += 1
                room[s] -= size
                for j in range(width):
                    want[s][j] -= item.vector[j]
        open_items = [i for i in open_items if i.share is None]


def assign_splits(messages: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, component_id, label_class, split) of every record.

    ``targets``: split, ratio (a handful of rows; ratios are scaled to sum 1). A null label counts as "other". Empty
    ``messages`` give an empty result.
    """
    wanted = sorted(((r["split"], float(r["ratio"])) for r in targets.filter("ratio > 0").collect()), key=lambda x: (-x[1], x[0]))
    if not wanted:
        raise ValueError("split targets hold no positive ratio")
    names, ratios = [n for n, _ in wanted], [r / sum(x for _, x in wanted) for _, r in wanted]
    ties = message_components(messages, None, hashes=False).select("component_id", "id")
    rows = messages.select("id", label_class(F.col("label")).alias("label_class")).join(ties, "id", "left")
    rows = cut(rows.withColumn("component_id", F.coalesce("component_id", "id")))
    n = rows.count()
    columns = [F.sum((F.col("label_class") == x).cast("int")).alias(f"v_{x}") for x in (*LABELS, "other")]
    vector = [f"v_{x}" for x in (*LABELS, "other")]
    comps = rows.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"), *columns)
    fine = F.concat_ws(",", *vector)
    coarse = F.concat(
        F.lit("~"), F.floor(F.log2("size") * 2).cast("string"), F.lit(":"),
        F.concat_ws(",", *[F.when(F.col(v) > 0, 1 + F.floor(F.col(v) * 7 / F.col("size"))).otherwise(0) for v in vector]),
    )
    least_big = max(EXACT + 1, n // BIG)
    kind = F.when(F.col("size") >= least_big, F.concat(F.lit("!"), "component_id")).when(F.col("size") <= EXACT, fine).otherwise(coarse)
    comps = cut(comps.withColumn("class", kind).withColumn("h", F.xxhash64("component_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS))))
    sums = comps.groupBy("class").agg(F.count(F.lit(1)).alias("m"), *[F.avg(v).alias(v) for v in vector])
    items = [Item(r["class"], r["m"], [float(r[v]) for v in vector]) for r in sums.collect()]
    place(items, ratios)
    spark = messages.sparkSession
    plan_rows, schema = [], "class string, " + ", ".join(f"upto{k} long" for k in range(len(names)))
    for item in items:
        run, upto = 0, []
        for s in item.share or []:
            run += s
            upto.append(run)
        plan_rows.append((item.key, *upto))
    plan = F.broadcast(spark.createDataFrame(plan_rows, schema))  # classes and big components: bounded, see above
    offsets = comps.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("class", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("h", "component_id"))
    ranked = comps.select("component_id", "class", "bucket", rank.alias("r")).join(offsets, ["class", "bucket"]).join(plan, "class")
    split = F.lit(names[-1])
    for k in reversed(range(len(names) - 1)):
        split = F.when(F.col("r") + F.col("before") <= F.col(f"upto{k}"), names[k]).otherwise(split)
    placed = ranked.select("component_id", split.alias("split"))
    return rows.join(placed, "component_id").select("id", "component_id", "label_class", "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows, share, target and deviation per split, with the share of each label class inside the split."""
    per = assigned.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("component_id").alias("n_groups"),
        *[F.avg((F.col("label_class") == x).cast("double")).alias(f"share_{x}") for x in (*LABELS, "other")],
    )
    all_rows = F.sum("n_rows").over(Window.partitionBy())
    per = per.withColumn("share", F.col("n_rows") / all_rows)
    return targets.select("split", F.col("ratio").alias("target")).join(per, "split", "left").withColumn("deviation", F.col("share") - F.col("target"))
