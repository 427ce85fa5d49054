"""Offer documents as cells, rendered from the order tables.

Every order is an offer: a block of requisites (block 0) and an item table (block 1) with
a header, one row for each line and, in some, a total. Numbers are text in five local
forms. Conflicts, blanks and second labels are planted by fixed moduli of the ids.
Items and heads are SQL, too, so that the same offers can be had elsewhere; the numbers' texts are one SQL text for two dialects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPARK = {"group": "format_number({0}, 0)", "div": "({0} div {1})", "date": "date_format({0}, 'dd.MM.yyyy')", "str": "cast({0} as string)", "long": "cast({0} as bigint)"}
DUCKDB = {"group": "format('{{:,}}', {0})", "div": "({0} // {1})", "date": "strftime({0}, '%d.%m.%Y')", "str": "cast({0} as varchar)", "long": "cast({0} as bigint)"}


TEXTS = ("qty_text", "unit_text", "total_text")


def texts_sql(d: dict) -> dict[str, str]:
    """Numbers of an item as the offer's texts."""
    f = lambda name, *a: d[name].format(*a)

    def money(c: str) -> str:
        whole, part = f("div", c, "100"), f"lpad({f('str', f'{c} % 100')}, 2, '0')"
        return f"""CASE doc_id % 5 WHEN 0 THEN concat({f('str', whole)}, '.', {part}) WHEN 1 THEN concat({f('str', whole)}, ',', {part})
          WHEN 2 THEN concat(replace({f('group', whole)}, ',', ' '), ',', {part}, ' KZT') WHEN 3 THEN concat({f('group', whole)}, '.', {part}) ELSE {f('group', whole)} END"""

    return {
        "qty_text": f"CASE WHEN (doc_id + item) % 29 = 0 THEN '' ELSE {f('str', 'qty')} END",
        "unit_text": f"CASE WHEN (doc_id + item) % 23 = 0 THEN '' ELSE {money('unit')} END",
        "total_text": money("total"),
    }


def items_sql(d: dict) -> str:
    f = lambda name, *a: d[name].format(*a)
    unit = f("div", f("long", "round(l_extendedprice * 100)"), f("long", "l_quantity"))
    text = texts_sql(d)

    return f"""
    SELECT doc_id, item, l_partkey, l_suppkey, qty, unit, total, p_name AS name,
           {text['qty_text']} AS qty_text,
           {text['unit_text']} AS unit_text, {text['total_text']} AS total_text
    FROM (SELECT i.*, unit * qty + CASE WHEN l_partkey % 7 = 0 THEN 50 ELSE 0 END AS total FROM
      (SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, {f('long', 'l_quantity')} AS qty, {unit} AS unit,
              {f('long', '''row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)''')} AS item
       FROM lineitem) i) x JOIN part ON p_partkey = l_partkey"""


def heads_sql(d: dict) -> str:
    """One row for each order: requisites and the number of its items."""
    f = lambda name, *a: d[name].format(*a)
    return f"""
    SELECT o_orderkey AS doc_id, concat('Коммерческое предложение № ', {f('str', 'o_orderkey')}, ' от ', {f('date', 'o_orderdate')}) AS title,
           c_name, s_name, coalesce(n, 0) AS n, coalesce(sum_total, 0) AS sum_total
    FROM orders JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT doc_id, {f('long', 'count(*)')} AS n, {f('long', 'sum(total)')} AS sum_total, min(CASE WHEN item = 1 THEN l_suppkey END) AS supp FROM items GROUP BY doc_id) t ON t.doc_id = o_orderkey
    LEFT JOIN supplier ON s_suppkey = supp"""


def cells_sql(d: dict) -> str:
    f = lambda name, *a: d[name].format(*a)
    total = f"concat({f('str', f('div', 'sum_total', '100'))}, '.', lpad({f('str', 'sum_total % 100')}, 2, '0'))"
    n = lambda x: f("long", x)
    meta = [
        ("1", "1", "title", "text", "true"),
        ("2", "1", "CASE WHEN doc_id % 11 = 0 THEN 'Клиент:' ELSE concat('Клиент: ', c_name) END", "text", "true"),
        ("3", "1", "'Поставщик'", "table", "s_name IS NOT NULL"),
        ("3", "2", "s_name", "table", "s_name IS NOT NULL"),
        ("4", "1", "CASE doc_id % 4 WHEN 0 THEN 'Валюта: KZT' WHEN 1 THEN 'Валюта: ₽' WHEN 2 THEN 'Валюта: USD' ELSE 'Валюта: тенге' END", "text", "true"),
        ("5", "1", "concat('Заказчик: ', c_name, ' LLC')", "text", "doc_id % 13 = 0"),
        ("6", "1", "CASE WHEN doc_id % 34 = 0 THEN 'НДС: 12%' ELSE 'НДС: 12% включен' END", "text", "doc_id % 17 = 0"),
        ("7", "1", "'Скидка: 5%'", "text", "doc_id % 19 = 0"),
        ("8", "1", f"concat('Итого к оплате: ', {total})", "text", "doc_id % 3 = 1 AND n > 0"),
        ("9", "1", "concat('Действительно до: ', CASE WHEN doc_id % 7 = 0 THEN '31.02.2027' ELSE '28.02.2027' END)", "text", "doc_id % 2 = 0"),
    ]
    out = [f"SELECT doc_id, {n('0')} AS block, {n(r)} AS row, {n(c)} AS col, {text} AS text, '{kind}' AS kind FROM heads WHERE {cond}" for r, c, text, kind, cond in meta]
    names = [("'Наименование'", "'Наименование товара'", 1, 3), ("'Кол-во'", "'Количество'", 2, 5), ("'Ед. изм.'", "'Ед'", 3, 2), ("'Цена'", "'Цена за ед.'", 4, 4), ("'Сумма'", "'Всего'", 5, 1)]
    for a, b, x, y in names:
        out.append(f"SELECT doc_id, {n('1')}, {n('1')}, {n(f'CASE WHEN doc_id % 2 = 0 THEN {x} ELSE {y} END')}, CASE WHEN doc_id % 2 = 0 THEN {a} ELSE {b} END, 'table' FROM heads WHERE n > 0")
    for text, x, y in (("name", 1, 3), ("qty_text", 2, 5), ("'шт'", 3, 2), ("unit_text", 4, 4), ("total_text", 5, 1)):
        out.append(f"SELECT doc_id, {n('1')}, item + 1, {n(f'CASE WHEN doc_id % 2 = 0 THEN {x} ELSE {y} END')}, {text}, 'table' FROM items")
    for text, x, y in (("'Итого'", 1, 3), (total, 5, 1)):
        out.append(f"SELECT doc_id, {n('1')}, n + 2, {n(f'CASE WHEN doc_id % 2 = 0 THEN {x} ELSE {y} END')}, {text}, 'table' FROM heads WHERE n > 0 AND doc_id % 3 = 0")
    return "\n UNION ALL ".join(out)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


#: Order lines that go to one task at most, but for those of one offer.
LINES_A_TASK = 1 << 17
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _by_offer(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows by ``doc_id``, in as many parts as the number of order lines asks for: what a task sorts does not grow with the tables."""
    parts = lines.count() // LINES_A_TASK
    standing = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "doc_id") if parts > standing else rows


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines with the names of their parts as a list, so that lines are numbered after parts are met; and the bare lines."""
    t = tables(spark, sf_dir, "lineitem", "part")
    names = t["part"].groupBy("p_partkey").agg(F.collect_list(F.struct("p_name")).alias("names"))
    i = t["lineitem"].join(names, F.col("l_partkey") == F.col("p_partkey"), "left")
    return i.select(F.col("l_orderkey").alias("doc_id"), *_ORDER, "names"), t["lineitem"]


def _priced(rows: DataFrame) -> DataFrame:
    """Numbered lines with quantity, unit price and total in hundredths, one for each name of their part."""
    rows = rows.select("*", F.explode("names").alias("p")).withColumn("name", F.col("p.p_name")).drop("names", "p")
    rows = rows.withColumn("qty", F.expr("cast(l_quantity as bigint)")).withColumn("unit", F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)"))
    return rows.withColumn("total", F.expr("unit * qty + CASE WHEN l_partkey % 7 = 0 THEN 50 ELSE 0 END"))


def _texts(c: str) -> Column:
    return F.expr(texts_sql(SPARK)[c])


def offer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item, qty, unit, total, name, texts): money in hundredths. Lines lie by ``doc_id`` afterwards, so that what is asked of offers finds them together."""
    rows, lines = _lines(spark, sf_dir)
    order = Window.partitionBy("doc_id").orderBy(*_ORDER)
    i = _priced(_by_offer(rows, lines).withColumn("item", F.row_number().over(order).cast("long")))
    return i.select("doc_id", "item", "l_partkey", "l_suppkey", "qty", "unit", "total", "name", *[_texts(c).alias(c) for c in TEXTS])


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines and, behind those of each offer, its head (``head``), which has the number of its items, their sum and the supplier of
    the first. Lines and heads are shuffled together once, and what a head has of its lines is read where they are."""
    rows, lines = _lines(spark, sf_dir)
    t = tables(spark, sf_dir, "orders", "customer", "supplier")
    heads = t["orders"].join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", "c_name")
    both = rows.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)).withColumn("names", F.array(F.struct(F.lit(None).cast("string").alias("p_name")))), allowMissingColumns=True)
    # heads come after the lines, so that these are numbered from 1
    order = Window.partitionBy("doc_id").orderBy("head", *_ORDER)
    both = _priced(_by_offer(both, lines).withColumn("item", F.row_number().over(order).cast("long")))
    whole, line, known = Window.partitionBy("doc_id"), ~F.col("head"), F.col("doc_id").isNotNull()
    first = F.min(F.when(line & (F.col("item") == 1), F.col("l_suppkey")))
    counts = {"n": F.count_if(line).over(whole), "sum_total": F.coalesce(F.sum("total").over(whole), F.lit(0)), "supp": first.over(whole)}
    both = both.withColumns(counts).withColumns({"n": F.when(known, F.col("n")).otherwise(0), "sum_total": F.when(known, F.col("sum_total")).otherwise(0), "supp": F.when(known, F.col("supp"))})
    suppliers = t["supplier"].select("s_suppkey", "s_name", F.lit(True).alias("s_head"))  # only heads meet them
    return both.join(suppliers, (F.col("supp") == F.col("s_suppkey")) & (F.col("head") == F.col("s_head")), "left")


_TITLE = "concat('Коммерческое предложение № ', cast(doc_id as string), ' от ', date_format(o_orderdate, 'dd.MM.yyyy'))"


def offer_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir).where("head").select("doc_id", F.expr(_TITLE).alias("title"), "c_name", "s_name", "n", "sum_total")


def offer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block, row, col, text, kind) of all offers, by ``doc_id``. Each line and each head explodes to the numbers of its cells, by
    which fixed values are looked up and the others told apart; ``cells_sql`` says the same cell by cell."""
    rows = _offers(spark, sf_dir)
    d, n, even, head, yes = F.col("doc_id"), F.col("n"), F.col("doc_id") % 2 == 0, F.col("head"), F.lit(True)
    total = F.concat_ws(".", F.expr("cast(sum_total div 100 as string)"), F.expr("lpad(cast(sum_total % 100 as string), 2, '0')"))
    said = lambda label, value: F.concat(F.lit(label), value)
    # row (None: that of the item, 0: below the items), columns of even and odd offers, text (a pair: of even and odd ones), kind, condition
    own = [(None, x, y, text, "table", yes) for text, x, y in ((F.col("name"), 1, 3), (_texts("qty_text"), 2, 5), (("шт", "шт"), 3, 2), (_texts("unit_text"), 4, 4), (_texts("total_text"), 5, 1))]
    has_supplier, has_items = F.col("s_name").isNotNull(), n > 0
    meta = [
        (1, 1, 1, F.expr(_TITLE), "text", yes),
        (2, 1, 1, F.when(d % 11 == 0, "Клиент:").otherwise(said("Клиент: ", F.col("c_name"))), "text", yes),
        (3, 1, 1, ("Поставщик", "Поставщик"), "table", has_supplier),
        (3, 2, 2, F.col("s_name"), "table", has_supplier),
        (4, 1, 1, said("Валюта: ", F.get(F.array(*map(F.lit, ("KZT", "₽", "USD", "тенге"))), (d % 4).cast("int"))), "text", yes),
        (5, 1, 1, F.concat(F.lit("Заказчик: "), F.col("c_name"), F.lit(" LLC")), "text", d % 13 == 0),
        (6, 1, 1, F.when(d % 34 == 0, "НДС: 12%").otherwise("НДС: 12% включен"), "text", d % 17 == 0),
        (7, 1, 1, ("Скидка: 5%", "Скидка: 5%"), "text", d % 19 == 0),
        (8, 1, 1, said("Итого к оплате: ", total), "text", (d % 3 == 1) & has_items),
        (9, 1, 1, said("Действительно до: ", F.when(d % 7 == 0, "31.02.2027").otherwise("28.02.2027")), "text", d % 2 == 0),
    ]
    table = [(1, x, y, (a, b), "table", has_items) for a, b, x, y in (("Наименование", "Наименование товара", 1, 3), ("Кол-во", "Количество", 2, 5), ("Ед. изм.", "Ед", 3, 2), ("Цена", "Цена за ед.", 4, 4), ("Сумма", "Всего", 5, 1))]
    table += [(0, x, y, text, "table", has_items & (d % 3 == 0)) for text, x, y in ((("Итого", "Итого"), 1, 3), (total, 5, 1))]
    cells = [*own, *meta, *table]
    block = [0 if own and len(own) <= i < len(own) + len(meta) else 1 for i in range(len(cells))]
    k = F.col("k")
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), k)
    either = lambda values: F.when(even, of([v[0] for v in values])).otherwise(of([v[1] for v in values]))
    heads = F.array_compact(F.array(*[F.when(c[5], F.lit(i)) for i, c in enumerate(cells) if i >= len(own)]))
    rows = rows.withColumn("k", F.explode(F.when(head, heads).otherwise(F.array(*[F.lit(i) for i in range(len(own))]))))
    place = F.when(~head, F.col("item") + 1).when(of([c[0] or 0 for c in cells]) == 0, n + 2).otherwise(of([c[0] or 0 for c in cells]))
    fixed = either([c[3] if isinstance(c[3], tuple) else (None, None) for c in cells])
    text = reduce(lambda so, i: so.when(k == i, cells[i][3]), [i for i, c in enumerate(cells) if i and not isinstance(c[3], tuple)], F.when(k == 0, cells[0][3]))
    once = F.explode(F.array(text.otherwise(fixed)))  # a one-row generator, so that a text is not made anew for each use
    return rows.select("doc_id", of(block).cast("long").alias("block"), place.cast("long").alias("row"), either([c[1:3] for c in cells]).cast("long").alias("col"), once.alias("text"), of([c[4] for c in cells]).alias("kind"))


#: The same three tables as common table expressions of DuckDB.
CTE = f"items AS MATERIALIZED ({items_sql(DUCKDB)}), heads AS MATERIALIZED ({heads_sql(DUCKDB)}), cells AS MATERIALIZED ({cells_sql(DUCKDB)})"
