"""Mailbox views over append-only tables: mails, analyses, folder moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the store.
FOLDERS = ("hop_thu_den", "thu_rac", "cach_ly", "da_xoa")
PREDICTIONS = ("normal", "spam", "phishing")
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def latest(rows: DataFrame, key: str, at: str, id_col: str) -> DataFrame:
    """Latest row of each key by time, then id; rows repeated in full count once."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(id_col).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_latest_analysis(mails: DataFrame, analyses: DataFrame, how: str = "left") -> DataFrame:
    return mails.join(latest(analyses, "id_thu", "thoi_gian_phan_tich", "id_phan_tich"), "id_thu", how)


def needs_attention(warning: Column, level: Column) -> Column:
    return (F.coalesce(warning, F.lit(0)) == 1) | F.coalesce(F.upper(level).isin("HIGH", "CRITICAL"), F.lit(False))


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie between 1 and 1000")
    if offset < 0:
        raise ValueError("offset must not be negative")


def page(mails: DataFrame, folder: str | None = None, unread: bool | None = None, starred: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first by the stored text of the time, then id."""
    check_page(limit, offset)
    if folder is not None:
        if folder not in FOLDERS:
            raise ValueError(f"unknown folder {folder}")
        mails = mails.filter(F.col("thu_muc") == folder)
    if unread is not None:
        mails = mails.filter(F.col("da_doc") == (0 if unread else 1))
    if starred is not None:
        mails = mails.filter(F.col("da_gan_sao") == int(starred))
    at = F.coalesce("ngay_gui", "thoi_gian_tao")
    return mails.orderBy(at.desc_nulls_last(), F.col("id_thu").desc()).offset(offset).limit(limit)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(mails: DataFrame, needle: str, columns: tuple[str, ...] = ("nguoi_gui", "tieu_de", "noi_dung")) -> DataFrame:
    """Literal substring in any column; only ASCII letters match in either case; no wild cards."""
    wanted = "".join(c.lower() if c.isascii() else c for c in needle)
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(ascii_lower(F.col(c)).contains(wanted), F.lit(False))
    return mails.filter(cond)


def folder_counts(mails: DataFrame) -> DataFrame:
    """All folders, zeros included, with unread and starred counts."""
    per = mails.groupBy("thu_muc").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("da_doc") == 0, 1).otherwise(0)).alias("unread"), F.sum(F.when(F.col("da_gan_sao") == 1, 1).otherwise(0)).alias("starred")
    )
    names = mails.sparkSession.createDataFrame([(f,) for f in FOLDERS], "thu_muc string")
    return names.join(F.broadcast(per), "thu_muc", "left").fillna(0, ["total", "unread", "starred"])


def security_counts(mails: DataFrame, analyses: DataFrame) -> DataFrame:
    both = with_latest_analysis(mails.select("id_thu"), analyses, "inner")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    level = F.upper("muc_rui_ro")
    return both.agg(
        F.count(F.lit(1)).alias("analysed"), n(F.col("co_canh_bao") == 1).alias("warnings"), n(level == "HIGH").alias("high"),
        n(level == "CRITICAL").alias("critical"), n(needs_attention(F.col("co_canh_bao"), F.col("muc_rui_ro"))).alias("attention"),
    )


def moves(history: DataFrame) -> DataFrame:
    """Folder moves in order within each mail; rows repeated in full count once."""
    w = Window.partitionBy("id_thu").orderBy(F.col("thoi_gian_thay_doi").asc_nulls_first(), "id_lich_su")
    return history.dropDuplicates().withColumn("step", F.row_number().over(w))


def current_folder(mails: DataFrame, history: DataFrame) -> DataFrame:
    """Folder after the last real move; a mail without moves keeps its own."""
    real = history.filter(~F.col("thu_muc_moi").eqNullSafe(F.col("thu_muc_cu")))
    last = latest(real, "id_thu", "thoi_gian_thay_doi", "id_lich_su").select("id_thu", "thu_muc_moi")
    return mails.join(last, "id_thu", "left").withColumn("folder_now", F.coalesce("thu_muc_moi", "thu_muc"))


def first_deliveries(mails: DataFrame) -> DataFrame:
    """One row per external id (the smallest own id); mails without one are all kept."""
    w = Window.partitionBy("ma_thu_ngoai").orderBy("id_thu")
    known = mails.filter("ma_thu_ngoai is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return known.unionByName(mails.filter("ma_thu_ngoai is null"))


def new_deliveries(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming mails whose external id is not stored yet, each once."""
    return first_deliveries(incoming).join(stored.select("ma_thu_ngoai").filter("ma_thu_ngoai is not null"), "ma_thu_ngoai", "left_anti")


def violations(mails: DataFrame, analyses: DataFrame, history: DataFrame) -> DataFrame:
    """(rule, n_rows) of each broken constraint of the store, zeros included."""
    ids = mails.select("id_thu")
    rules = {
        "mail_folder": mails.filter(~F.col("thu_muc").isin(*FOLDERS) | F.col("thu_muc").isNull()),
        "mail_flags": mails.filter(~F.col("da_doc").isin(0, 1) | ~F.col("da_gan_sao").isin(0, 1)),
        "analysis_prediction": analyses.filter(~F.col("nhan_du_doan").isin(*PREDICTIONS) | F.col("nhan_du_doan").isNull()),
        "analysis_level": analyses.filter(~F.col("muc_rui_ro").isin(*RISK_LEVELS) | F.col("muc_rui_ro").isNull()),
        "analysis_ranges": analyses.filter("do_tin_cay < 0 or do_tin_cay > 1 or diem_rui_ro < 0 or diem_rui_ro > 100"),
        "analysis_json": analyses.filter("ket_qua_json is not null and try_parse_json(ket_qua_json) is null"),
        "analysis_without_mail": analyses.join(ids, "id_thu", "left_anti"),
        "move_without_mail": history.join(ids, "id_thu", "left_anti"),
    }
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("rule"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
