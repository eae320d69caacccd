"""Export to and import from JSON lines, one folder a table, with the schema declared and mistakes refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagecask.operators.archive import Archive, export_pages, export_snippets, import_data

PAGES = (
    "url string, title string, first_seen long, last_visit long, visit_count long, typed_count long, lang string, flags int, saved_at long, "
    "content_hash string, content_indexed_at long, headings string, description string, body string"
)
SNIPPETS = "url string, page_title string, text string, fragment string, truncated boolean, created_at long"


def write_export(state: Archive, folder: str, scope: str = "all") -> None:
    export_pages(state, scope).write.mode("overwrite").json(f"{folder}/pages")
    export_snippets(state).write.mode("overwrite").json(f"{folder}/snippets")


def read_export(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    read = lambda schema, t: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{t}")
    return read(PAGES, "pages"), read(SNIPPETS, "snippets")


def import_export(state: Archive, folder: str) -> tuple[Archive, DataFrame]:
    return import_data(state, *read_export(state.pages.sparkSession, folder))
