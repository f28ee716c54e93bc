"""Uploads, pages and catalogs as DataFrames.

Archives are opened in tasks, one file each; rendering pages and reading images or models is not done here
but by a reader function that the caller injects.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import ascii_filename, digits, normalize_description

#: Fixed value: bytes of a document beyond which it isn't read.
MOST_BYTES = 50 * 1024 * 1024
_MEMBERS = "file_id string, name string, content binary, error string"


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, name, content) of all files under a path, by Spark's own binary reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("path", 256).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def expand_uploads(uploads: DataFrame, suffix: str = ".pdf", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(file_id, name, content, error): documents kept, members of archives under their own name.

    error tells why a file or member isn't a document, or is too large a one; its content is null then. A member
    that is too large is known by the archive's list and isn't unpacked."""
    too_large = f"larger than {most_bytes} bytes"

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, name, content in zip(batch["file_id"], batch["name"], batch["content"], strict=True):
                if not name.lower().endswith(".zip"):
                    error = "neither a document nor an archive" if not name.lower().endswith(suffix) else too_large if len(content) > most_bytes else None
                    rows = [(file_id, name, None if error else content, error)]
                else:
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as archive:
                            for entry in archive.infolist():
                                if not entry.is_dir():
                                    own = entry.filename.rpartition("/")[2]
                                    error = "member is not a document" if not own.lower().endswith(suffix) else too_large if entry.file_size > most_bytes else None
                                    yield pd.DataFrame([(file_id, own, None if error else archive.read(entry), error)], columns=["file_id", "name", "content", "error"])
                        continue
                    except zipfile.BadZipFile:
                        rows = [(file_id, name, None, "not a valid archive")]
                yield pd.DataFrame(rows, columns=["file_id", "name", "content", "error"])

    return uploads.select("file_id", "name", "content").mapInPandas(members, _MEMBERS)


def rejected_rows(expanded: DataFrame) -> DataFrame:
    """Review rows of what was no document."""
    return expanded.where("error IS NOT NULL").select(F.col("name").alias("file"), F.lit("Arquivo não suportado").alias("detected_type"), F.col("error").alias("reason"), F.lit(100).alias("confidence"), F.lit("Movido para Outros automaticamente.").alias("notes"))


def split_pages(files: DataFrame, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(file_id, page, content): pages by an injected splitter; a file it fails on is one page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    parts = split(content)
                except Exception:  # a splitter may fail in any way
                    parts = [content]
                yield pd.DataFrame({"file_id": file_id, "page": range(1, len(parts) + 1), "content": parts})

    return files.where("content IS NOT NULL").select("file_id", "content").mapInPandas(run, "file_id string, page int, content binary")


def read_pages(pages: DataFrame, reader: Callable[[bytes], str]) -> DataFrame:
    """(file_id, page, text, error): text by an injected reader; a page it fails on has its error instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for content in batch["content"]:
                try:
                    text, error = reader(content), None
                except Exception as problem:  # one page must not fail the others
                    text, error = None, str(problem)
                texts.append(text)
                errors.append(error)
            yield batch[["file_id", "page"]].assign(text=texts, error=errors)

    return pages.mapInPandas(run, "file_id string, page int, text string, error string")


def read_where_needed(pages: DataFrame, need: Column, reader: Callable[[bytes], str]) -> DataFrame:
    """pages(file_id, page, content, text): the reader is called for those that need it only."""
    seen = pages.where(~need).select("file_id", "page", "text", F.lit(None).cast("string").alias("error"))
    return seen.unionByName(read_pages(pages.where(need).select("file_id", "page", "content"), reader))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("file_id").agg(F.count("*").alias("page_count"))


def subset_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, file_id, page, ...): the pages of each document(document_id, file_id, pages), those there are."""
    wanted = documents.select("document_id", "file_id", F.explode("pages").alias("page"))
    return pages.join(wanted, ["file_id", "page"])


def document_name(name: Column | str) -> Column:
    return ascii_filename(name)


def resolve_columns(columns: list[str], normal: list[str]) -> tuple[str, str, str | None, str | None]:
    """(code, description, longer description, cost centre) columns by their normalised headers."""
    pairs = list(zip(columns, normal, strict=True))
    code = next((c for c, k in pairs if k == "CODIGO" or k.endswith(" CODIGO")), None) or next((c for c, k in pairs if "CODIGO" in k and "BARRAS" not in k), None)
    described = [c for c, k in pairs if k.startswith("DESCRICAO")]
    short = next((c for c, k in pairs if k == "DESCRICAO"), described[0] if described else None)
    if code is None or short is None:
        raise ValueError(f"the catalog has no code or description column: {', '.join(columns)}")
    centre = next((c for c, k in pairs if "CENTRO" in k and "CUSTO" in k), None)
    return code, short, described[1] if len(described) > 1 else None, centre


def prepare_catalog(raw: DataFrame, order: str | None = None, ncm_col: str = "Pos.IPI/NCM") -> DataFrame:
    """Catalog rows: idx, code, description, description_extra, cost_centre, match_text, match_text_extra, ncm.

    order: a column with each row's place; without one rows are numbered as they are read. Rows that are all
    null go, then those without a code or description; short extra descriptions are blanked."""
    columns = [c for c in raw.columns if c != order]
    heads = raw.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "i int, c string").select("i", normalize_description("c").alias("k")).orderBy("i").collect()
    code, short, longer, centre = resolve_columns(columns, [r["k"] for r in heads])

    def text(c: str | None) -> Column:
        return F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c else F.lit("")

    numbered = raw.where(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns]).isNotNull()).withColumn("idx", F.col(order).cast("long") if order else F.monotonically_increasing_id())
    extra = F.when(F.length(normalize_description(text(longer))) >= 5, text(longer)).otherwise("")
    ncm = digits(F.col(f"`{ncm_col}`").cast("string")) if ncm_col in raw.columns else F.lit("")
    rows = numbered.select("idx", text(code).alias("code"), text(short).alias("description"), extra.alias("description_extra"), text(centre).alias("cost_centre"), ncm.alias("ncm"))
    kept = rows.where("code <> '' AND description <> ''")
    return kept.withColumn("match_text", normalize_description("description")).withColumn("match_text_extra", normalize_description("description_extra"))


def read_catalog(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A prepared catalog from Parquet, CSV or another of Spark's formats."""
    return prepare_catalog(spark.read.options(header="true", **options).format(kind).load(path))


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """The newest session of every owner."""
    newest = W.partitionBy("owner").orderBy(F.desc("created_at"))
    return sessions.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def signed_in(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """(token, username, name): sessions that haven't expired, with their users."""
    return sessions.where(F.col("expires_at") > now).join(users, "username").select("token", "username", "name")
