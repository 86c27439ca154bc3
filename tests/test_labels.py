"""Labels, sizes and thresholds that results have to show, written out once more: oracles and engine can't agree on a wrong one."""

from stocktide.functions import text
from stocktide.operators import match, pallet, reconcile, report, sync
from stocktide.sinks import text as text_sinks
from stocktide.sinks import workbook
from stocktide.sources import files


def test_statuses_actions_and_methods():
    assert (reconcile.CHANGED, reconcile.SAME, reconcile.NO_PRODUCT, reconcile.NO_VARIATION, reconcile.UNMATCHED, reconcile.NEED_QTY) == ("有差异", "一致", "本店无此商品", "本店无此尺码", "未能匹配", "需人工填数量")
    assert (reconcile.BY_HAND, reconcile.NOTHING, reconcile.NO_FIELD) == ("需要人工处理", "无需更新", "（无字段需要更新）")
    assert (match.RULE, match.RULE_MISSING, match.SKU, match.COMBO, match.NAME, match.NONE) == ("人工映射", "映射的 SKU 在本店不存在", "SKU 相同", "组合商品 SKU 命中", "商品名相同", "未匹配")
    assert (sync.DONE, sync.FAILED, sync.SKIPPED, sync.REHEARSED, sync.NO_VARIATION) == ("成功", "失败", "跳过", "演练（未提交）", "找不到变体")
    assert text.STATUS_LABELS == {"instock": "有货", "outofstock": "缺货"} and (text.YES, text.NO) == ("是", "否")


def test_headers_and_names():
    assert report.DIFF_HEADER == ("状态", "来源", "分区/品类", "来源商品", "来源尺码", "本店 SKU", "本店商品", "变体 ID", "来源数量", "在线数量", "数量差", "来源库存状态", "在线库存状态", "本店是否管理库存", "匹配方式", "将要执行的更新", "备注")
    assert report.TODO_HEADER == ("来源", "分区/品类", "来源商品/货号", "尺码范围", "尺码数", "近似货号建议（本店）", "建议商品名", "处理建议")
    assert sync.LOG_COLUMNS == ("序号", "结果", "来源商品", "尺码", "本店 SKU", "本店商品", "变体 ID", "更新前", "更新请求", "更新后", "错误信息")
    assert files.RULE_HEADER == ("source", "category", "source_product", "parent_sku", "size_map", "note") and files.UNIFIED_SUFFIX == "_统一库存.xlsx" and files.COMBINED == "全部库存_合并.xlsx"
    assert (workbook.UNIFIED, workbook.DETAIL, workbook.SAME, workbook.MANUAL, workbook.TODO, workbook.SUMMARY) == ("统一库存", "差异明细", "无差异", "需人工处理", "待处理商品清单", "汇总")
    assert text_sinks.MARKDOWN_MANUAL == ("来源商品", "尺码", "状态", "说明")


def test_sizes_and_thresholds():
    assert pallet.SIZES == ("XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL") and set(pallet.SIZE_WORDS) - set(pallet.SIZES) == {"2XL", "3XL"}
    assert (pallet.GREEN, pallet.LEAST, pallet.GAP, pallet.COLUMN, pallet.BAND_ROW, pallet.BAND_WIDTH, pallet.BAND_GREY, pallet.CELL) == (60, 3, 90.0, 15.0, 6.0, 300, (0.5, 0.92), 11.5)
    assert text.SIZE_ALIASES == {"2XL": "XXL", "3XL": "XXXL", "ONE SIZE": "OS", "均码": "OS", "F": "OS"} and text.SIZE_SUFFIXES == "码号"
    assert files.DEFAULTS["options"] == {"fuzzy_threshold": 0.86, "include_combo_skus": False} and files.DEFAULTS["store"]["per_page"] == 100
