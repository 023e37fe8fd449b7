"""Project discovery over a table of file paths.

Input rows are (project, path) with ``path`` relative to the project folder,
as a recursive file listing gives them.  Everything is ``regexp_extract`` on
paths plus per-project conditional aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's rules.
MODEL_FOLDER_SUFFIXES = (".semanticmodel", ".dataset")
REPORT_SUFFIX = ".Report"


def _folder_parts(paths: DataFrame) -> DataFrame:
    top = F.regexp_extract("path", r"^([^/]+)/", 1)
    return paths.select("project", "path", top.alias("folder"))


def discover_models(paths: DataFrame) -> DataFrame:
    """Per project, (status, model_folder).

    Candidates are top-level folders ending in .SemanticModel or .Dataset (any
    case).  None -> 'missing'; one -> it; several -> the one whose stem equals
    the project file's stem (when a .pbip file exists), else 'ambiguous'.  The
    chosen folder is 'ok' with a definition/ folder, 'legacy' with model.bim,
    else 'invalid'.
    """
    p = _folder_parts(paths)
    low = F.lower("folder")
    is_cand = (F.col("folder") != "") & (low.endswith(MODEL_FOLDER_SUFFIXES[0]) | low.endswith(MODEL_FOLDER_SUFFIXES[1]))
    cands = (p.where(is_cand).groupBy("project", "folder")
             .agg(F.bool_or(F.col("path").startswith(F.concat(F.col("folder"), F.lit("/definition/")))).alias("has_definition"),
                  F.bool_or(F.col("path") == F.concat(F.col("folder"), F.lit("/model.bim"))).alias("has_bim")))
    stems = (paths.where(F.lower("path").rlike(r"^[^/]+\.pbip$"))
             .groupBy("project").agg(F.min(F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)).alias("pbip_stem")))
    c = cands.join(stems, "project", "left").withColumn(
        "stem_match", F.lower(F.regexp_extract("folder", r"^(.*)\.[^.]*$", 1)) == F.lower("pbip_stem"))
    per = (c.groupBy("project")
           .agg(F.count(F.lit(1)).alias("n_candidates"),
                F.count_if(F.coalesce("stem_match", F.lit(False))).alias("n_matches"),
                F.min("folder").alias("only_folder"),
                F.min(F.when(F.col("stem_match"), F.col("folder"))).alias("match_folder")))
    chosen = F.when(F.col("n_candidates") == 1, F.col("only_folder")).when(F.col("n_matches") == 1, F.col("match_folder"))
    projects = paths.select("project").distinct()
    res = projects.join(per, "project", "left").withColumn("model_folder", chosen)
    res = res.join(cands.select("project", F.col("folder").alias("model_folder"), "has_definition", "has_bim"),
                   ["project", "model_folder"], "left")
    status = (F.when(F.coalesce("n_candidates", F.lit(0)) == 0, F.lit("missing"))
              .when(F.col("model_folder").isNull(), F.lit("ambiguous"))
              .when(F.col("has_definition"), F.lit("ok"))
              .when(F.col("has_bim"), F.lit("legacy"))
              .otherwise(F.lit("invalid")))
    return res.select("project", status.alias("status"), "model_folder")


def resolve_report(paths: DataFrame) -> DataFrame:
    """Per project, the report folder (exact '<stem>.Report', else the first '*.Report') and its format.

    'classic' when report.json exists in it (S3), else 'pages' (S4).
    """
    p = _folder_parts(paths)
    reports = p.where(F.col("folder").endswith(REPORT_SUFFIX))
    stems = (paths.where(F.lower("path").rlike(r"^[^/]+\.pbip$"))
             .groupBy("project").agg(F.min(F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)).alias("pbip_stem")))
    r = (reports.groupBy("project", "folder")
         .agg(F.bool_or(F.col("path") == F.concat(F.col("folder"), F.lit("/report.json"))).alias("has_report_json"))
         .join(stems, "project", "left")
         .withColumn("not_exact", ~F.coalesce(F.col("folder") == F.concat(F.col("pbip_stem"), F.lit(REPORT_SUFFIX)), F.lit(False))))
    best = r.groupBy("project").agg(F.min_by(F.struct("folder", "has_report_json"), F.struct("not_exact", "folder")).alias("b"))
    return best.select("project", F.col("b.folder").alias("report_folder"),
                       F.when(F.col("b.has_report_json"), F.lit("classic")).otherwise(F.lit("pages")).alias("report_format"))
