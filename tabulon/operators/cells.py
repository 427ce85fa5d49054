"""Operators on the cell table (doc_id, block, row, col, text, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import classify, may_name
from ..functions.numbers import numeric_quote, strip
from ..sources.store import stage

# Heads of summary and footer rows, and requisite labels.
SUMMARY = r"(?iu)^(?:итого|всего|к оплате|общая сумма|ндс|скидка|subtotal|grand total|total)(?:[\s:,.]|$)"
FOOTER = r"(?iu)^(?:примечание|подпись|страница|с уважением)(?:[\s:,.]|$)"
REQUISITES = {
    "title": ("название", "тема", "title"),
    "client": ("клиент", "заказчик", "покупатель", "client", "customer"),
    "clientContact": ("контактное лицо", "контакт", "контакты", "телефон", "email", "e-mail", "clientContact"),
    "validUntil": ("действительно до", "срок действия", "предложение действительно до", "validUntil"),
    "supplier": ("поставщик", "исполнитель", "продавец", "supplier", "жеткізуші"),
    "currency": ("валюта", "currency"),
    "vat": ("ндс", "налог", "vat"),
    "discount": ("скидка", "discount"),
    "delivery": ("доставка", "стоимость доставки", "delivery"),
    "paymentTerms": ("условия оплаты", "оплата", "paymentTerms"),
    "deliveryTerms": ("срок поставки", "сроки поставки", "условия поставки", "deliveryTerms"),
    "warranty": ("гарантия", "гарантийный срок", "warranty"),
    "documentNumber": ("номер документа", "номер", "№ документа", "documentNumber"),
    "documentDate": ("дата документа", "дата", "documentDate"),
    "documentTotal": ("итого к оплате", "всего к оплате", "к оплате", "общая сумма", "итого", "всего", "documentTotal"),
}
LABELS = "(?iu)^(?:" + "|".join(x for k, v in REQUISITES.items() if k != "title" for x in v) + r")(?:\s*[:=]|\s+|$)"
ROW = ("doc_id", "block", "row")
#: Cells that go to one task at most, but for those of one block.
CELLS_A_TASK = 1 << 21


def text_cells(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of plain texts as cells. A line with a tab, a bar or two spaces is cut there
    and is a table row; neighbouring lines of one kind share a numbered block."""
    lines = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n")).alias("line", "t"))
    parts = F.array_remove(F.transform(F.split("t", r"\t|\||[ \t]{2,}"), lambda x: strip(x)), "")
    lines = lines.withColumn("parts", parts).where(F.size("parts") > 0).withColumn("kind", F.when(F.size("parts") > 1, "table").otherwise("text"))
    order = Window.partitionBy("doc_id").orderBy("line")
    turn = F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("long"), F.lit(1))
    lines = lines.withColumn("turn", turn).withColumn("block", F.sum("turn").over(order))
    rows = lines.withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("line")).cast("long"))
    return rows.select("doc_id", "block", "row", F.posexplode("parts").alias("p", "text"), "kind").select("doc_id", "block", "row", (F.col("p") + 1).cast("long").alias("col"), "text", "kind")


def row_groups(cells: DataFrame) -> DataFrame:
    """(doc_id, block, row, cells): the cells of each row in order."""
    return cells.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("cells"))


def cell_roles(cells: DataFrame) -> DataFrame:
    """(text, role) of the table cells that name a column. All known labels are words, so that
    a text without a letter, or a number with a currency code, is never near one and is not classified."""
    texts = cells.where("kind = 'table'").where(may_name(F.col("text")))
    # written, so that its size is known before cells are joined: if it is small, cells stay where they are
    return stage(classify(texts, "text").where("method in ('alias', 'semantic')").select("text", "role"), "roles")


def spread(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells of a written table by document and block (or by ``keys``), in as many parts as their number asks for: what a task sorts or holds does
    not grow with the table, and all that is asked of rows and blocks finds them together."""
    keys = keys or ("doc_id", "block")
    parts = cells.count() // CELLS_A_TASK
    standing = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, *keys) if parts > standing else cells.repartition(*keys)


FACTS = ("filled", "numbers", "words", "roles", "names", "summaries", "footers", "labels")


def told(cells: DataFrame) -> DataFrame:
    """Cells (text, number, known) with a flag ``f_`` for each of the facts by which rows are judged; ``known`` is the role of a text as a column's
    name. Flags are columns of their own, so that a text is stripped and searched once and aggregates only count."""
    c = cells.withColumn("__t", strip(F.col("text")))
    filled, number = F.col("__t") != "", F.col("number")
    said = lambda pattern: filled & number.isNull() & F.col("__t").rlike(pattern)  # noqa: E731 - a number opens with none of these
    flags = (filled, number.isNotNull(), filled & number.isNull(), F.col("known").isNotNull(), F.col("known") == "name", said(SUMMARY), said(FOOTER), said(LABELS))
    return c.withColumns({f"f_{k}": v for k, v in zip(FACTS, flags, strict=True)}).drop("__t")


def fact_counts() -> list[Column]:
    return [F.count_if(f"f_{k}").alias(k) for k in FACTS]


def known_texts(cells: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """``cell_roles`` as (text, known)."""
    return (cell_roles(cells) if roles is None else roles).withColumnRenamed("role", "known")


def row_facts(cells: DataFrame) -> DataFrame:
    """What rows are judged by: one row for each row of cells."""
    # as many rows as there are different cell texts with a role: aliases and near them
    c = spread(cells.select(*ROW, "text")).withColumn("number", numeric_quote(F.col("text"))).join(known_texts(cells), "text", "left")
    return told(c).groupBy(*ROW).agg(*fact_counts())


def excluded(f=F.col) -> Column:
    """Whether a row of ``row_facts`` is a summary, footer, header or requisite row."""
    header = (f("names") > 0) & ((f("roles") >= 2) | (f("numbers") == 0))
    return (f("summaries") > 0) | (f("footers") > 0) | header | ((f("filled") <= 2) & (f("labels") > 0))


def candidates(facts: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Rows that may be items and that no mapping covers."""
    found = facts.where(~excluded()).where("filled >= 2 and numbers >= 1 and words >= 1").select(*ROW)
    return found if covered is None else found.join(covered.select(*ROW).distinct(), list(ROW), "left_anti")


def outside(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells outside all item ranges (doc_id, block, first, last) of their block."""
    hit = (cells.doc_id == ranges.doc_id) & (cells.block == ranges.block) & cells.row.between(ranges["first"], ranges["last"])
    return cells.join(ranges, hit, "left_anti")


def sampled(facts: DataFrame) -> DataFrame:
    """``facts`` with ``pick``: whether a row is one of those that stand for its block - all of up to 12; else the first
    5, 6 rows of words only, 6 headers, the first 2 and the middle number row, the last 3."""
    per = Window.partitionBy("doc_id", "block").orderBy("row")
    whole = Window.partitionBy("doc_id", "block")
    f = facts.withColumn("n", F.count("*").over(whole)).withColumn("at", F.row_number().over(per))
    for name, cond in (("wordy", "numbers = 0"), ("header", "names > 0"), ("numeric", "numbers > 0")):
        f = f.withColumn(name, F.expr(cond).cast("long")).withColumn(f"{name}_at", F.sum(name).over(per)).withColumn(f"{name}_n", F.sum(name).over(whole))
    pick = (F.col("n") <= 12) | (F.col("at") <= 5) | (F.col("at") > F.col("n") - 3)
    pick = pick | ((F.col("wordy") == 1) & (F.col("wordy_at") <= 6)) | ((F.col("header") == 1) & (F.col("header_at") <= 6))
    pick = pick | ((F.col("numeric") == 1) & ((F.col("numeric_at") <= 2) | (F.col("numeric_at") == F.expr("numeric_n div 2 + 1"))))
    return f.select(*facts.columns, pick.alias("pick"))


def block_catalog(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Size of each block and the rows that stand for it, those that are ``sampled``."""
    sample = F.array_join(F.sort_array(F.collect_list(F.when(F.col("pick"), F.col("row")))).cast("array<string>"), ",")
    return sampled(facts).groupBy("doc_id", "block").agg(F.count("*").alias("n_rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), sample.alias("sample"))
