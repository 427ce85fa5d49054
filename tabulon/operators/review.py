"""Drafts of labels on their way to people: which are imported, in which form, and which stored ones give way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dataset import review_queue, without

SPLITS = ("train", "val", "test", "review_only")
#: What a reason says to a person.
MESSAGES = {
    "E_PARSE": "Ошибка чтения документа.",
    "E_TIMEOUT": "Превышено время обработки.",
    "E_SCHEMA": "Ответ модели не соответствует контракту.",
    "E_GROUNDING": "Проверьте ссылки, цитаты и границы таблиц.",
    "E_OCR": "Проверьте качество OCR и полноту извлечения.",
    "E_COLUMNS": "Роль колонки не подтверждена распознанным заголовком.",
    "E_ROWS": "В диапазоне товаров есть неоднозначные строки.",
    "E_COVERAGE": "Возможно пропущена таблица или товарные строки.",
    "E_ARITHMETIC": "Суммы требуют проверки с учётом НДС, скидки и округления.",
    "E_FIELD_CONFLICT": "Правила и модель по-разному извлекли реквизит.",
    "E_NO_ITEMS": "Товарные таблицы не подтверждены.",
    "E_CONTEXT": "Задание не помещается в контекст; обрезка запрещена.",
    "E_MODEL": "Модель не завершила обработку.",
    "E_CONVERSION": "Не завершена локальная конвертация DOC.",
    "E_RESOURCE": "Недостаточно ресурсов для этапа.",
}
OTHER = "Требуется проверка."


def review_rows(drafts: DataFrame) -> DataFrame:
    """Drafts as people get them: nothing is confirmed yet. Every field is pending and every table not reviewed; reasons become
    messages, which follow the warnings, each once and in the order of its first place."""
    said = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    none = F.array().cast("array<string>")
    reasons = F.coalesce("reasons", none)
    issues = F.transform(reasons, lambda c: F.coalesce(F.element_at(said, c), F.lit(OTHER)))
    return drafts.select(
        "doc_id", F.lit(1).cast("long").alias("revision"), F.lit("draft").alias("status"), F.lit(False).alias("human_reviewed"), "split", F.coalesce("label_status", F.lit("unprocessed")).alias("label_status"),
        reasons.alias("reasons"), issues.alias("issues"), F.array_distinct(F.concat(F.coalesce("warnings", none), issues)).alias("warnings"),
        F.transform("fields", lambda f: f.withField("state", F.lit("pending"))).alias("fields"), F.transform("tables", lambda t: t.withField("reviewed", F.lit(False))).alias("tables"),
    )


def import_review(stored: DataFrame, drafts: DataFrame, excluded: DataFrame, limit: int, rebalance: bool = False) -> DataFrame:
    """The annotation table after an import of at most ``limit`` drafts (doc_id, split, format, label_status, reasons, warnings, fields, tables).

    The queue goes round splits, and inside them round formats with reasons; excluded documents and other splits are not in it. A stored document
    is never replaced. With ``rebalance`` stored drafts of these documents that are untouched (revision 1, a draft, said not to be
    reviewed by a person) go first; one without that statement stays. Of repeated drafts of a document the least by split, format and reasons counts;
    null ids are not imported. ``limit`` is a feature of the queue."""
    d = without(drafts.where(F.col("doc_id").isNotNull() & F.col("split").isin(*SPLITS)), excluded, "doc_id")
    d = d.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in drafts.columns if c != "doc_id"]), F.struct("split", "format", "reasons")).alias("d")).select("doc_id", "d.*")
    if rebalance:
        untouched = (F.col("revision") == 1) & (F.col("status") == "draft") & (F.col("human_reviewed") == False)  # noqa: E712 - a null is no statement
        going = stored.where(untouched).select("doc_id").join(d.select("doc_id"), "doc_id", "left_semi")
        stored = without(stored, going, "doc_id")
    queue = review_queue(d.select("doc_id", "split", "format", "reasons"), "split", ("format", "reasons"), "doc_id", SPLITS, limit).select("doc_id")
    fresh = without(d.join(queue, "doc_id"), stored, "doc_id")
    return stored.unionByName(review_rows(fresh))
