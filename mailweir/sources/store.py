"""A versioned mailbox store on append-only Parquet tables.

One writer. The batches of a commit are written first and then named, all together, in one manifest that is renamed into
place: readers see all tables of a commit or none. The path lies on a file system that the driver and the executors share.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweir.operators.mailbox import FOLDERS, current_folder, latest, new_deliveries, with_latest_analysis

VERSION = 2
# What a reader may say of a mail, and the folder that it then belongs to (none: it stays).
FEEDBACK = {"mark_spam": "thu_rac", "mark_phishing": "cach_ly", "mark_safe": "hop_thu_den", "delete": "da_xoa", "restore": "hop_thu_den", "report_error": None}
TABLES = {
    "thu": "id_thu long, ma_thu_ngoai string, nguoi_gui string, nguoi_nhan string, cc string, tieu_de string, noi_dung string, ngay_gui string, thu_muc string, da_doc int, da_gan_sao int, thoi_gian_tao string",
    "phan_tich_thu": "id_phan_tich long, id_thu long, phien_ban_mo_hinh string, nhan_du_doan string, do_tin_cay double, diem_rui_ro double, muc_rui_ro string, co_canh_bao int, ket_qua_json string, thoi_gian_phan_tich string",
    "lich_su_thu_muc": "id_lich_su long, id_thu long, thu_muc_cu string, thu_muc_moi string, ly_do string, thoi_gian_thay_doi string",
    "su_kien": "id_thu long, loai string, gia_tri int, thoi_gian string",
    "phan_hoi": "id_thu long, hanh_dong string, thu_muc_cu string, thu_muc_moi string, ghi_chu string, thoi_gian string",
}


class MailStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        os.makedirs(path, exist_ok=True)
        mark = os.path.join(path, "version.json")
        if os.path.exists(mark):
            with open(mark) as f:
                found = json.load(f)["version"]
            if found > VERSION:
                raise ValueError(f"the store has version {found}; this program knows {VERSION}")
        else:
            with open(mark + ".new", "w") as f:
                json.dump({"version": VERSION}, f)
            os.replace(mark + ".new", mark)
        for t in TABLES:
            os.makedirs(os.path.join(path, t), exist_ok=True)

    def _manifest(self) -> dict[str, list[str]]:
        path = os.path.join(self.path, "manifest.json")
        if not os.path.exists(path):
            return {t: [] for t in TABLES}
        with open(path) as f:
            return {**{t: [] for t in TABLES}, **json.load(f)}

    def table(self, name: str) -> DataFrame:
        batches = [os.path.join(self.path, name, b) for b in self._manifest()[name]]
        return self.spark.read.schema(TABLES[name]).parquet(*batches) if batches else self.spark.createDataFrame([], TABLES[name])

    def commit(self, **frames: DataFrame) -> None:
        """Append one batch to each table, all or none; leftovers of a failed run are named nowhere and not read."""
        manifest = self._manifest()
        stamp = f"batch-{uuid.uuid4().hex}"
        for name, df in frames.items():
            columns = [c.split()[0] for c in TABLES[name].split(", ")]
            df.select(*columns).write.parquet(os.path.join(self.path, name, stamp))
            manifest[name] = [*manifest[name], stamp]
        new = os.path.join(self.path, f"manifest-{stamp}.new")
        with open(new, "w") as f:
            json.dump(manifest, f)
        os.replace(new, os.path.join(self.path, "manifest.json"))

    def receive(self, mails: DataFrame, analyses: DataFrame | None = None) -> int:
        """Store the mails whose external id is new (each once), with their analyses; returns how many."""
        fresh = new_deliveries(mails, self.table("thu")).cache()
        n = fresh.count()
        if n:
            frames = {"thu": fresh}
            if analyses is not None:
                frames["phan_tich_thu"] = analyses.join(fresh.select("id_thu"), "id_thu", "left_semi")
            self.commit(**frames)
        fresh.unpersist()
        return n

    def move(self, ids: DataFrame, folder: str, reason: str, at: str) -> int:
        """Record moves of the mails that stand elsewhere now; a blank reason or unknown folder is an error."""
        if folder not in FOLDERS:
            raise ValueError(f"unknown folder {folder}")
        if not reason.strip():
            raise ValueError("a move needs a reason")
        now = current_folder(self.table("thu"), self.table("lich_su_thu_muc"))
        moved = now.join(ids.select("id_thu").distinct(), "id_thu", "left_semi").filter(F.col("folder_now") != folder)
        rows = self._moves(moved.select("id_thu", F.col("folder_now").alias("thu_muc_cu"), F.lit(folder).alias("thu_muc_moi")), reason, at).cache()
        n = rows.count()
        if n:
            self.commit(lich_su_thu_muc=rows)
        rows.unpersist()
        return n

    def view(self) -> DataFrame:
        """Every mail with its folder and flags now and its latest analysis."""
        mails = self.table("thu").drop("da_doc", "da_gan_sao").join(self.flags(), "id_thu")
        return with_latest_analysis(current_folder(mails, self.table("lich_su_thu_muc")), self.table("phan_tich_thu"))

    def flags(self) -> DataFrame:
        """(id_thu, da_doc, da_gan_sao) of every mail: its last event of each kind, else what was stored with it."""
        events = self.table("su_kien")
        last = latest(events.withColumn("_k", F.concat_ws("|", "id_thu", "loai")), "_k", "thoi_gian", "gia_tri")
        read = last.filter("loai = 'read'").select("id_thu", F.col("gia_tri").alias("_r"))
        star = last.filter("loai = 'star'").select("id_thu", F.col("gia_tri").alias("_s"))
        mails = self.table("thu").select("id_thu", "da_doc", "da_gan_sao").join(read, "id_thu", "left").join(star, "id_thu", "left")
        return mails.select("id_thu", F.coalesce("_r", "da_doc", F.lit(0)).alias("da_doc"), F.coalesce("_s", "da_gan_sao", F.lit(0)).alias("da_gan_sao"))

    def set_flag(self, ids: DataFrame, kind: str, value: bool, at: str) -> int:
        """Record read events where the state changes, and star events always; returns how many. Unknown ids are an error."""
        if kind not in ("read", "star"):
            raise ValueError(f"unknown flag {kind}")
        wanted = self._existing(ids)
        now = self.flags().join(wanted, "id_thu", "left_semi")
        rows = now.filter(F.col("da_doc") != int(value)) if kind == "read" else now
        rows = rows.select("id_thu", F.lit(kind).alias("loai"), F.lit(int(value)).alias("gia_tri"), F.lit(at).alias("thoi_gian")).cache()
        n = rows.count()
        if n:
            self.commit(su_kien=rows)
        rows.unpersist()
        return n

    def _existing(self, ids: DataFrame) -> DataFrame:
        ids = ids.select("id_thu").distinct()
        lost = ids.join(self.table("thu").select("id_thu"), "id_thu", "left_anti").limit(5).collect()
        if lost:
            raise KeyError(f"no such mails: {sorted(r['id_thu'] for r in lost)}")
        return ids

    def feedback(self, ids: DataFrame, action: str, at: str, note: str = "") -> int:
        """Record an action on mails and move those that stand elsewhere than where it sends them; returns how many moved.

        The action is always recorded; analyses never change.
        """
        if action not in FEEDBACK:
            raise ValueError(f"unknown action {action}")
        wanted = self._existing(ids)
        now = current_folder(self.table("thu"), self.table("lich_su_thu_muc")).join(wanted, "id_thu", "left_semi")
        goal = F.coalesce(F.lit(FEEDBACK[action]), F.col("folder_now"))
        rows = now.select("id_thu", F.lit(action).alias("hanh_dong"), F.col("folder_now").alias("thu_muc_cu"), goal.alias("thu_muc_moi"), F.lit(note).alias("ghi_chu"), F.lit(at).alias("thoi_gian")).cache()
        moved = self._moves(rows.filter("thu_muc_cu <> thu_muc_moi"), f"feedback: {action}", at).cache()
        n = moved.count()
        self.commit(phan_hoi=rows, **({"lich_su_thu_muc": moved} if n else {}))
        rows.unpersist()
        moved.unpersist()
        return n

    def _moves(self, rows: DataFrame, reason: str, at: str) -> DataFrame:
        top = self.table("lich_su_thu_muc").agg(F.coalesce(F.max("id_lich_su"), F.lit(0)).alias("m")).first()["m"]
        return rows.select((F.lit(top) + F.col("id_thu")).alias("id_lich_su"), "id_thu", "thu_muc_cu", "thu_muc_moi", F.lit(reason).alias("ly_do"), F.lit(at).alias("thoi_gian_thay_doi"))

    def open_mail(self, id_thu: int, at: str, mark_read: bool = True) -> DataFrame:
        """One row: the mail in its folder with its flags and latest analysis; it is marked as read on request."""
        one = self.spark.createDataFrame([(id_thu,)], "id_thu long")
        if mark_read:
            self.set_flag(one, "read", True, at)
        else:
            self._existing(one)
        return self.view().filter(F.col("id_thu") == id_thu)

    def health(self) -> DataFrame:
        """(check, found): version, rows and batches of each table, and rows that point to no mail."""
        manifest = self._manifest()
        rows = [("version", VERSION)] + [(f"batches of {t}", len(manifest[t])) for t in TABLES]
        out = self.spark.createDataFrame(rows, "check string, found long")
        ids = self.table("thu").select("id_thu")
        for t in TABLES:
            out = out.unionByName(self.table(t).agg(F.count(F.lit(1)).alias("found")).select(F.lit(f"rows of {t}").alias("check"), "found"))
            if t != "thu":
                lost = self.table(t).join(ids, "id_thu", "left_anti").agg(F.count(F.lit(1)).alias("found"))
                out = out.unionByName(lost.select(F.lit(f"{t} without mail").alias("check"), "found"))
        return out
