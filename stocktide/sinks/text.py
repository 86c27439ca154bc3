"""Text files: reports in Markdown and HTML, JSON and CSV tables, and a console preview. Long tables are written line by line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.functions import text
from stocktide.functions.text import html_escaped
from stocktide.operators import reconcile, report
from stocktide.sources.files import RULE_HEADER

# Titles and headers of the reports.
TITLE = "库存差异比对报告"
MARKDOWN_HEADER = ("来源商品", "尺码", "本店 SKU", "本店商品", "来源数量", "在线数量", "来源状态", "在线状态", "将执行的更新")
MARKDOWN_FROM = (3, 4, 5, 6, 8, 9, 11, 12, 15)  # of the display columns
PARTS = (("changed", "一、有差异"), ("manual", "二、需要人工处理"), ("same", "三、无差异（无需更新）"))
# Fixed values, too: what the tables of the Markdown report are called, and what their columns hold.
MARKDOWN_TITLES = ("一、有差异（按商品汇总）", "一之二、有差异（逐条明细）", "二、需要人工处理", "三、无差异（无需更新）")
MARKDOWN_BY_PRODUCT = ("来源", "品类/分区", "来源商品", "本店商品（SKU）", "尺寸变化", "说明")
MARKDOWN_MANUAL = ("来源商品", "尺码", "状态", "说明")
PREVIEW_COUNTS, PREVIEW_MANUAL, PREVIEW_CHANGED, PREVIEW_MORE = "有差异 {changed}，一致 {same}，需人工处理 {manual}", "需人工处理的商品（来源 · 品类 · 商品 · 尺码数）", "有差异（商品 · 尺码 · SKU · 数量 · 状态）", "另有 {}"
MARKED = (8, 9, 10, 11, 12)  # display columns that HTML marks on changed rows


def _line(values) -> str:
    """A row of a Markdown table."""
    return "| " + " | ".join("-" if v is None or v == "" else str(v).replace("|", "\\|") for v in values) + " |\n"


def write_markdown(diffs: DataFrame, path: str, meta: dict | None = None) -> str:
    """Changes by product and one by one, manual rows with status and note, unchanged rows."""
    shown = report.present(diffs)
    parts = report.parts(diffs)
    detail = lambda *kinds: shown.where(F.col("status").isin(*kinds)).orderBy("ord").select(*[report.DIFF_HEADER[k] for k in MARKDOWN_FROM])
    by_product = report.changes_by_product(diffs).join(report.first_rows(parts["changed"]), list(report.PRODUCT)).orderBy("ord")
    product = F.concat(F.coalesce(F.nullif("product_name", F.lit("")), F.lit("-")), F.lit("（"), F.coalesce(F.nullif("parent_sku", F.lit("")), F.lit("-")), F.lit("）"))
    tables = (
        (MARKDOWN_TITLES[0], MARKDOWN_BY_PRODUCT, by_product.select("source", "category", "source_product", product, "items", "first_note")),
        (MARKDOWN_TITLES[1], MARKDOWN_HEADER, detail(reconcile.CHANGED)),
        (MARKDOWN_TITLES[2], MARKDOWN_MANUAL, parts["manual"].orderBy("ord").select("source_product", "size", "status", "note")),
        (MARKDOWN_TITLES[3], MARKDOWN_HEADER, detail(reconcile.SAME)),
    )
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {TITLE}\n\n" + "".join(f"- {k}：{v}\n" for k, v in (meta or {}).items()))
        for r in report.summary_rows(diffs).orderBy("line").collect():
            f.write(f"- {r['label']}：**{r['figure']}**\n")
        for title, header, rows in tables:
            f.write(f"\n## {title}\n\n{_line(header)}{_line(['---'] * len(header))}")
            f.writelines(_line(r) for r in rows.toLocalIterator())
    return path


def write_html(diffs: DataFrame, products: DataFrame, path: str, meta: dict | None = None) -> str:
    shown = report.present(diffs)
    cells = [html_escaped(F.col(c)).alias(c) for c in report.DIFF_HEADER]
    kinds = {"changed": [reconcile.CHANGED], "manual": list(reconcile.MANUAL), "same": [reconcile.SAME]}

    def table(f, header, rows, kind: str, marked=()) -> None:
        f.write(f'<table class="{kind}"><tr>' + "".join(f"<th>{h}</th>" for h in header) + "</tr>\n")
        for r in rows:
            f.write("<tr>" + "".join(f"<td{' class=chg' if k in marked else ''}>{v}</td>" for k, v in enumerate(r)) + "</tr>\n")
        f.write("</table>\n")

    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html><html lang="zh-CN"><head><meta charset="utf-8"><title>{TITLE}</title><style>.changed td{{background:#ffc7ce}} td.chg{{background:#ff7c80}} .same td{{background:#e2efda}} .manual td{{background:#ffeb9c}}</style></head><body><h1>{TITLE}</h1>\n')
        f.write("".join(f"<p>{k}：{v}</p>" for k, v in (meta or {}).items()))
        for part, title in PARTS:
            f.write(f"<h2>{title}</h2>\n")
            if part == "manual":
                todo = report.todo(diffs, products, ignore_case=True).orderBy("ord").drop("ord")
                table(f, report.TODO_HEADER, todo.select(*[html_escaped(F.col(c)) for c in todo.columns]).toLocalIterator(), part)
            rows = shown.where(F.col("status").isin(*kinds[part])).orderBy("ord").select(*cells)
            table(f, report.DIFF_HEADER, rows.toLocalIterator(), part, MARKED if part == "changed" else ())
        f.write("</body></html>\n")
    return path


def preview_text(diffs: DataFrame, limit: int = 25, groups: int = 12) -> str:
    """Counts, the first products to see to by hand, and the first changes; where there are more, how many."""
    counts = report.preview_counts(diffs).first()
    changed, manual = report.preview(diffs, limit, groups)
    status = [text.status_label(F.col(c)) for c in ("src_status", "store_status")]
    changes = changed.select("source_product", "size", "parent_sku", "src_qty", "store_qty", *[s.alias(f"s{k}") for k, s in enumerate(status)]).collect()
    out = [PREVIEW_COUNTS.format(**counts.asDict())]

    def listed(title: str, rows: list, more: int) -> None:
        if rows:
            out.extend(["", title, *(" · ".join("-" if v is None or v == "" else str(v) for v in r) for r in rows)])
        if more > 0:
            out.append(PREVIEW_MORE.format(more))

    listed(PREVIEW_MANUAL, [(r["source"], r["category"], r["source_product"], r["n"]) for r in manual.collect()], counts["groups"] - groups)
    listed(PREVIEW_CHANGED, [(r["source_product"], r["size"], r["parent_sku"], f"{_shown(r['store_qty'])} → {_shown(r['src_qty'])}", f"{r['s1']} → {r['s0']}") for r in changes], counts["changed"] - limit)
    return "\n".join(out)


def _shown(value) -> str:
    return "-" if value is None else str(value)


def write_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines, nulls included; used for diffs and statistics."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_rules(rules: DataFrame, path: str) -> str:
    """Mapping rules as one CSV file with a mark of byte order, in order."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(RULE_HEADER)
        for r in rules.orderBy("ord").select(*RULE_HEADER).toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    return path


def write_snapshot(images: DataFrame, path: str, store: str = "", created_at: str = "", dry_run: bool = True) -> str:
    """Before-images as JSON lines, written by Spark: `before` is an object with the fields that the image has."""
    fields = F.transform(F.map_entries("before"), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(": "), e["value"]))
    before = F.coalesce(F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}")), F.lit("null"))
    about = json.dumps({"created_at": created_at, "store": store, "dry_run": dry_run}, ensure_ascii=False)[:-1]
    rest = F.to_json(F.struct("product_id", "variation_id", "sku"), {"ignoreNullFields": "false"})
    line = F.concat(F.lit(about + ", "), F.substring(rest, F.lit(2), F.length(rest) - 2), F.lit(', "before": '), before, F.lit("}"))
    images.repartitionByRange("product_id", "variation_id").sortWithinPartitions("product_id", "variation_id").select(line.alias("value")).write.mode("overwrite").text(path)
    return path
