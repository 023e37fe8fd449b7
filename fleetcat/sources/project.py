"""Project folders to catalog tables: one recursive file scan, discovery (S2, S6), segmentation (T1-T11), layouts.

A project is a folder that holds ``X.SemanticModel`` (or ``.Dataset``) and
``X.Report`` folders, as the desktop tool saves them.  Files are told apart by
their paths; no partition folders are needed.  Every table is keyed by project
and, where it comes from a definition file, by file.  JSON units that do not
parse become quarantine rows (S7) and drop nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcat.operators import segment
from fleetcat.sources import layout_json as layout
from fleetcat.sources.discover import discover_models, resolve_report
from fleetcat.sources.quarantine import parse_or_quarantine

FILE_KINDS = "*.{tmdl,json,pbip,bim}"
IN_PROJECT = r"([^/]+)/([^/]+\.(?i:SemanticModel|Dataset|Report)/.+|[^/]+\.(?i:pbip))$"
KEYS = ["project", "file"]


def read_project_files(spark: SparkSession, root: str) -> DataFrame:
    """(project, path, text) of every definition, layout and project file below a folder."""
    files = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", FILE_KINDS).load(root))
    where = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return files.select(F.regexp_extract(where, IN_PROJECT, 1).alias("project"), F.regexp_extract(where, IN_PROJECT, 2).alias("path"),
                        F.col("value").alias("text")).where("path <> ''")


def _below(files: DataFrame, chosen: DataFrame, folder: str, sub: str) -> DataFrame:
    """Files below ``folder/sub`` of each project's chosen folder, with ``file`` relative to it."""
    base = F.concat(F.col(folder), F.lit("/" + sub))
    return files.join(chosen, "project").where(F.col("path").startswith(base)).withColumn(
        "file", F.substring(F.col("path"), F.length(base) + 1, F.length("path")))


def catalog_of_projects(files: DataFrame) -> dict[str, DataFrame]:
    """Catalog tables of (project, path, text) rows.

    models, reports, tables, columns, measures, partitions, calculation_items,
    hierarchy_levels, relationships, expressions, pages, visuals, quarantined.
    """
    listing = files.select("project", "path")
    models, reports = discover_models(listing), resolve_report(listing)
    definition = _below(files, models.where("status = 'ok'").select("project", "model_folder"), "model_folder", "definition/")
    lines = lambda df: segment.lines_of(df.select(*KEYS, F.col("text").alias("value")), KEYS)
    table_files = definition.where(F.col("file").rlike(r"^tables/[^/]+\.tmdl$"))
    blocks = segment.table_blocks(lines(table_files), KEYS)
    names = segment.table_names_of_files(table_files.withColumnRenamed("text", "value"), KEYS)

    of_table = lambda df: df.join(names, KEYS)
    report_files = _below(files, reports, "report_folder", "")
    classic = report_files.where("report_format = 'classic' and file = 'report.json'")
    pages = report_files.where("report_format = 'pages'")
    key = ["project"]
    classic_pages = layout.layout_pages(classic, key, "text").select(
        "project", F.col("page_no").cast("string").alias("page"), "page_name", "page_hidden", "page_width", "page_height")
    file_pages = layout.page_file_pages(pages, key).select(
        "project", F.col("page_folder").alias("page"), "page_name", "page_hidden", "page_width", "page_height")
    shown = ["type", "title", "x", "y", "width", "height", "z", "hidden", "fields"]
    classic_visuals = layout.scan_layout_json(classic, key, "text").select(
        "project", F.col("page_no").cast("string").alias("page"), F.col("vis_no").cast("string").alias("visual"), *shown)
    file_visuals = layout.scan_page_files(pages, key).select(
        "project", F.col("page_folder").alias("page"), F.col("visual_folder").alias("visual"), *shown)

    units = [(classic, layout.LAYOUT_SCHEMA), (pages.where(F.col("file").endswith("/page.json")), layout.PAGE_SCHEMA),
             (pages.where(F.col("file").endswith("/visual.json")), layout.VISUAL_SCHEMA)]
    bad = [parse_or_quarantine(df, KEYS, "text", schema)[1] for df, schema in units]
    return {
        "models": models, "reports": reports, "tables": names,
        "columns": of_table(segment.columns(blocks, KEYS)), "measures": of_table(segment.measures(blocks, KEYS)),
        "partitions": of_table(segment.partitions(blocks, KEYS)), "calculation_items": of_table(segment.calculation_items(blocks, KEYS)),
        "hierarchy_levels": of_table(segment.hierarchy_levels(blocks, KEYS)),
        "relationships": segment.relationships(lines(definition.where("file = 'relationships.tmdl'")), KEYS),
        "expressions": segment.shared_expressions(lines(definition.where("file = 'expressions.tmdl'")), KEYS),
        "pages": classic_pages.unionByName(file_pages), "visuals": classic_visuals.unionByName(file_visuals),
        "quarantined": bad[0].unionByName(bad[1]).unionByName(bad[2]),
    }
