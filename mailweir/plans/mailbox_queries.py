"""Queries on the mailbox tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweir.operators import mailbox as M
from mailweir.plans.registry import Registry
from mailweir.sources.tables import table

query = Registry()
ANALYSIS = ("id_phan_tich", "id_thu", "nhan_du_doan", "ngon_ngu_phat_hien", "do_tin_cay", "diem_rui_ro", "muc_rui_ro", "co_canh_bao", "ket_qua_json", "thoi_gian_phan_tich")
LAST = """(select * from (select id_phan_tich, id_thu, nhan_du_doan, ngon_ngu_phat_hien, do_tin_cay, diem_rui_ro, muc_rui_ro, co_canh_bao, ket_qua_json, thoi_gian_phan_tich,
    row_number() over (partition by id_thu order by thoi_gian_phan_tich desc nulls last, id_phan_tich desc) as rn from phan_tich_thu) where rn = 1)"""
ATTENTION = "(coalesce(co_canh_bao,0) = 1 or coalesce(upper(muc_rui_ro) in ('HIGH','CRITICAL'), false))"


def _mails(spark, d):
    return table(spark, d, "thu")


def _analyses(spark, d):
    return table(spark, d, "phan_tich_thu", ANALYSIS)


@query("latest_analysis_left", f"select t.id_thu, a.id_phan_tich, a.nhan_du_doan, a.diem_rui_ro from thu t left join {LAST} a using (id_thu)")
def latest_analysis_left(spark, d):
    return M.with_latest_analysis(_mails(spark, d).select("id_thu"), _analyses(spark, d)).select("id_thu", "id_phan_tich", "nhan_du_doan", "diem_rui_ro")


@query("security_list", f"select t.id_thu, t.tieu_de, a.muc_rui_ro, a.diem_rui_ro, a.id_phan_tich from thu t join {LAST} a using (id_thu) where {ATTENTION}")
def security_list(spark, d):
    both = M.with_latest_analysis(_mails(spark, d).select("id_thu", "tieu_de"), _analyses(spark, d), "inner")
    return both.filter(M.needs_attention(F.col("co_canh_bao"), F.col("muc_rui_ro"))).select("id_thu", "tieu_de", "muc_rui_ro", "diem_rui_ro", "id_phan_tich")


@query("analysis_filters", f"select t.id_thu, a.ngon_ngu_phat_hien as detected from thu t join {LAST} a using (id_thu) where nhan_du_doan = 'phishing' and muc_rui_ro in ('HIGH','CRITICAL') and ngon_ngu_phat_hien is not null")
def analysis_filters(spark, d):
    both = M.with_latest_analysis(_mails(spark, d).select("id_thu"), _analyses(spark, d), "inner")
    return both.filter("nhan_du_doan = 'phishing' and muc_rui_ro in ('HIGH','CRITICAL') and ngon_ngu_phat_hien is not null").select("id_thu", F.col("ngon_ngu_phat_hien").alias("detected"))


@query("folder_counts", "select f.thu_muc, count(t.id_thu) as total, coalesce(sum(case when da_doc = 0 then 1 else 0 end),0)::bigint as unread, coalesce(sum(case when da_gan_sao = 1 then 1 else 0 end),0)::bigint as starred from (values ('hop_thu_den'),('thu_rac'),('cach_ly'),('da_xoa')) f(thu_muc) left join thu t using (thu_muc) group by 1")
def folder_counts(spark, d):
    return M.folder_counts(_mails(spark, d))


@query("security_counts", f"select count(*) as analysed, coalesce(sum(case when co_canh_bao = 1 then 1 else 0 end),0)::bigint as warnings, coalesce(sum(case when upper(muc_rui_ro) = 'HIGH' then 1 else 0 end),0)::bigint as high, coalesce(sum(case when upper(muc_rui_ro) = 'CRITICAL' then 1 else 0 end),0)::bigint as critical, coalesce(sum(case when {ATTENTION} then 1 else 0 end),0)::bigint as attention from thu join {LAST} a using (id_thu)")
def security_counts(spark, d):
    return M.security_counts(_mails(spark, d), _analyses(spark, d))


@query("mail_page", "select id_thu, tieu_de from thu where thu_muc = 'hop_thu_den' and da_doc = 0 order by coalesce(ngay_gui, thoi_gian_tao) desc nulls last, id_thu desc limit 40 offset 20")
def mail_page(spark, d):
    """One page of the inbox: the limit is the feature."""
    return M.page(_mails(spark, d), "hop_thu_den", unread=True, limit=40, offset=20).select("id_thu", "tieu_de")


@query("riskiest_mails", f"select id_thu, id_phan_tich, diem_rui_ro from {LAST} order by diem_rui_ro desc nulls last, id_phan_tich desc limit 100")
def riskiest_mails(spark, d):
    """The hundred riskiest mails: the limit is the feature."""
    last = M.latest(_analyses(spark, d), "id_thu", "thoi_gian_phan_tich", "id_phan_tich")
    return last.orderBy(F.col("diem_rui_ro").desc_nulls_last(), F.col("id_phan_tich").desc()).limit(100).select("id_thu", "id_phan_tich", "diem_rui_ro")


_A = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("literal_search", f"select id_thu from thu where contains({_A.format('nguoi_gui')}, '50%') or contains({_A.format('tieu_de')}, '50%') or contains({_A.format('noi_dung')}, '50%')")
def literal_search(spark, d):
    return M.search(_mails(spark, d), "50%").select("id_thu")


@query("ascii_case_search", f"select id_thu from thu where contains({_A.format('nguoi_gui')}, 'báo cáo') or contains({_A.format('tieu_de')}, 'báo cáo') or contains({_A.format('noi_dung')}, 'báo cáo')")
def ascii_case_search(spark, d):
    return M.search(_mails(spark, d), "báo cáo").select("id_thu")


@query("folder_history", "select id_thu, id_lich_su, thu_muc_cu, thu_muc_moi, row_number() over (partition by id_thu order by thoi_gian_thay_doi asc nulls first, id_lich_su) as step from (select distinct * from lich_su_thu_muc)")
def folder_history(spark, d):
    return M.moves(table(spark, d, "lich_su_thu_muc")).select("id_thu", "id_lich_su", "thu_muc_cu", "thu_muc_moi", F.col("step").cast("bigint").alias("step"))


@query("current_folder", "with l as (select id_thu, thu_muc_moi from (select *, row_number() over (partition by id_thu order by thoi_gian_thay_doi desc nulls last, id_lich_su desc) as n from lich_su_thu_muc where thu_muc_moi is distinct from thu_muc_cu) where n = 1) select id_thu, coalesce(thu_muc_moi, thu_muc) as folder_now from thu left join l using (id_thu)")
def current_folder(spark, d):
    return M.current_folder(_mails(spark, d).select("id_thu", "thu_muc"), table(spark, d, "lich_su_thu_muc")).select("id_thu", "folder_now")


@query("first_deliveries", "select id_thu from (select id_thu, ma_thu_ngoai, row_number() over (partition by ma_thu_ngoai order by id_thu) as n from thu) where n = 1 or ma_thu_ngoai is null")
def first_deliveries(spark, d):
    return M.first_deliveries(_mails(spark, d).select("id_thu", "ma_thu_ngoai")).select("id_thu")


@query("new_deliveries", "with s as (select * from thu where thoi_gian_tao < '2024-07-01'), i as (select * from thu where thoi_gian_tao >= '2024-07-01') select id_thu from (select id_thu, ma_thu_ngoai, row_number() over (partition by ma_thu_ngoai order by id_thu) as n from i) x where (n = 1 or ma_thu_ngoai is null) and not exists (select 1 from s where s.ma_thu_ngoai = x.ma_thu_ngoai)")
def new_deliveries(spark, d):
    t = _mails(spark, d).select("id_thu", "ma_thu_ngoai", "thoi_gian_tao")
    return M.new_deliveries(t.filter("thoi_gian_tao >= '2024-07-01'"), t.filter("thoi_gian_tao < '2024-07-01'")).select("id_thu")


@query(
    "store_violations",
    """select 'mail_folder' as rule, count(*) as n_rows from thu where thu_muc not in ('hop_thu_den','thu_rac','cach_ly','da_xoa') or thu_muc is null
    union all select 'mail_flags', count(*) from thu where da_doc not in (0,1) or da_gan_sao not in (0,1)
    union all select 'analysis_prediction', count(*) from phan_tich_thu where nhan_du_doan not in ('normal','spam','phishing') or nhan_du_doan is null
    union all select 'analysis_level', count(*) from phan_tich_thu where muc_rui_ro not in ('LOW','MEDIUM','HIGH','CRITICAL') or muc_rui_ro is null
    union all select 'analysis_ranges', count(*) from phan_tich_thu where do_tin_cay < 0 or do_tin_cay > 1 or diem_rui_ro < 0 or diem_rui_ro > 100
    union all select 'analysis_json', count(*) from phan_tich_thu where ket_qua_json is not null and not json_valid(ket_qua_json)
    union all select 'analysis_without_mail', count(*) from phan_tich_thu a where not exists (select 1 from thu t where t.id_thu = a.id_thu)
    union all select 'move_without_mail', count(*) from lich_su_thu_muc a where not exists (select 1 from thu t where t.id_thu = a.id_thu)""",
)
def store_violations(spark, d):
    return M.violations(_mails(spark, d), _analyses(spark, d), table(spark, d, "lich_su_thu_muc"))


@query("analysis_versions", "select phien_ban_mo_hinh, nhan_du_doan, count(*) as n_rows, round(avg(do_tin_cay), 6) as mean_confidence from phan_tich_thu group by all")
def analysis_versions(spark, d):
    a = table(spark, d, "phan_tich_thu", ("phien_ban_mo_hinh", "nhan_du_doan", "do_tin_cay"))
    return a.groupBy("phien_ban_mo_hinh", "nhan_du_doan").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("do_tin_cay"), 6).alias("mean_confidence"))


@query(
    "redelivery_threads",
    """with l as (select id_thu, thu_muc_moi from (select *, row_number() over (partition by id_thu order by thoi_gian_thay_doi desc nulls last, id_lich_su desc) as n from lich_su_thu_muc where thu_muc_moi is distinct from thu_muc_cu) where n = 1)
    select ma_thu_ngoai, count(*) as n, list_sort(list(distinct coalesce(thu_muc_moi, thu_muc))) as folders from thu left join l using (id_thu) where ma_thu_ngoai is not null group by 1 having count(*) > 1""",
)
def redelivery_threads(spark, d):
    """Copies of one external id with the folder each stands in now."""
    t = M.current_folder(_mails(spark, d), table(spark, d, "lich_su_thu_muc"))
    return t.filter("ma_thu_ngoai is not null").groupBy("ma_thu_ngoai").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("folder_now")).alias("folders")).filter("n > 1")


QUERIES, SQL = query.queries, query.sql
