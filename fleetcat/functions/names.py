"""Name predicates and field-name scalars.

Every builder returns a Catalyst ``Column`` so it stays inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetcat.functions.common import col_of, let, py_strip

# Fixed values that must equal the reference's rules.
# System-table name prefixes:
SYSTEM_TABLE_PREFIXES = ("LocalDateTable_", "DateTableTemplate_", "RowNumber-")
# Technical-object denylist (exact names), technical prefixes, and a case-insensitive leading pattern:
TECHNICAL_DENYLIST = (
    "ServerString", "NoRecords", "NrRecords", "Total Deliveries shells",
    "Last Refreshed (Local)", "Transparent", "BeginPeriod", "EndPeriod",
)
TECHNICAL_PREFIXES = ("!",)
TECHNICAL_PATTERN = "(?i)^Tooltip"
# Field roles ("wells") and their readable labels, in the reference's order:
WELL_LABELS = (
    ("Category", "X-axis"), ("X", "X-axis"), ("Axis", "X-axis"),
    ("Y", "Y-axis"), ("Y2", "Y-axis (secondary)"),
    ("Series", "Legend"), ("Legend", "Legend"),
    ("Values", "Value"), ("Rows", "Rows"), ("Columns", "Columns"),
    ("Tooltips", "Tooltips"), ("Details", "Detail"), ("Size", "Size"),
)
# Visual type -> readable label:
VISUAL_LABELS = (
    ("barChart", "Bar chart"), ("columnChart", "Column chart"),
    ("lineChart", "Line chart"), ("areaChart", "Area chart"),
    ("clusteredBarChart", "Clustered bar chart"),
    ("clusteredColumnChart", "Clustered column chart"),
    ("stackedBarChart", "Stacked bar chart"),
    ("stackedColumnChart", "Stacked column chart"),
    ("hundredPercentStackedBarChart", "100% stacked bar chart"),
    ("hundredPercentStackedColumnChart", "100% stacked column chart"),
    ("lineClusteredColumnComboChart", "Line + clustered column"),
    ("lineStackedColumnComboChart", "Line + stacked column"),
    ("ribbonChart", "Ribbon chart"), ("waterfallChart", "Waterfall chart"),
    ("funnelChart", "Funnel chart"), ("scatterChart", "Scatter chart"),
    ("pieChart", "Pie chart"), ("donutChart", "Donut chart"),
    ("treemap", "Treemap"), ("map", "Map"), ("filledMap", "Filled map"),
    ("shapeMap", "Shape map"), ("gauge", "Gauge"), ("kpi", "KPI"),
    ("card", "Card"), ("multiRowCard", "Multi-row card"),
    ("tableEx", "Table"), ("pivotTable", "Matrix"), ("matrix", "Matrix"),
    ("slicer", "Slicer"), ("textbox", "Text box"), ("image", "Image"),
    ("actionButton", "Button"), ("basicShape", "Shape"),
    ("decompositionTreeVisual", "Decomposition tree"),
    ("keyDriversVisual", "Key influencers"),
)
AGG_WRAPPERS = ("Sum", "Count", "Min", "Max", "Average", "Agg")

_WELL_ALT = "|".join(w for w, _ in WELL_LABELS)
_AGG = rf"(?id)^(?:{'|'.join(AGG_WRAPPERS)})\((.+)\)$"


def _map_lit(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def is_system_table(name) -> Column:
    """Auto-generated system table by name prefix."""
    c = col_of(name)
    out = F.lit(False)
    for p in SYSTEM_TABLE_PREFIXES:
        out = out | F.coalesce(c.startswith(p), F.lit(False))
    return out


def is_technical(name) -> Column:
    """Denylisted name, technical prefix, or leading 'Tooltip' in any case."""
    c = F.coalesce(col_of(name).cast("string"), F.lit("None"))
    out = c.isin(*TECHNICAL_DENYLIST)
    for p in TECHNICAL_PREFIXES:
        out = out | c.startswith(p)
    return out | c.rlike(TECHNICAL_PATTERN)


def safe_id(name) -> Column:
    """Every character that is not a letter or digit becomes '_'."""
    return F.regexp_replace(col_of(name).cast("string"), r"[^\p{L}\p{N}]", "_")


def well_of(raw) -> Column:
    """Role prefix of a raw field string ('Values' when none)."""
    c = col_of(raw)
    return F.when(_has_well(c), F.substring_index(c, ": ", 1)).when(c.isNotNull(), F.lit("Values"))


def well_label(well) -> Column:
    """Readable label of a role, falling back to the role itself."""
    c = col_of(well)
    return F.coalesce(F.try_element_at(_map_lit(WELL_LABELS), c), c)


def visual_label(vtype) -> Column:
    """Readable label of a visual type, falling back to the type."""
    c = col_of(vtype)
    return F.coalesce(F.try_element_at(_map_lit(VISUAL_LABELS), c), c)


def is_measure_field(raw) -> Column:
    """A field is a measure when it holds an aggregate wrapper or 'Measure'."""
    c = col_of(raw)
    return c.contains("Agg(") | c.contains("Measure")


# The steps of P12.  Each asks by plain string functions whether a pattern can match, and runs the pattern only then.

def _has_well(c: Column) -> Column:
    """A role and ': ' lead the text (no role holds ': ', so the first one ends it)."""
    return c.contains(": ") & F.substring_index(c, ": ", 1).isin(*[w for w, _ in WELL_LABELS])


def _drop_well(c: Column) -> Column:
    return F.when(_has_well(c), F.substring(c, F.length(F.substring_index(c, ": ", 1)) + 3, F.length(c))).otherwise(c)


def _after_arrow(s: Column) -> Column:
    # arrows that share a space are split from the left
    return F.when(s.contains(" -> -> "), F.element_at(F.split(s, " -> "), -1)).otherwise(F.substring_index(s, " -> ", -1))


def _bracket(s: Column) -> Column:
    """The first bracket's content ('' when there is none)."""
    inner = F.substring(s, F.length(F.substring_index(s, "[", 1)) + 2, F.length(s))
    return (F.when(~s.contains("["), F.lit("")).when(s.contains("[]"), F.regexp_extract(s, r"\[([^\]]+)\]", 1))
            .when(inner.contains("]"), F.substring_index(inner, "]", 1)).when(s.isNotNull(), F.lit("")))


def _resolved(s: Column, after: Column, bracket: Column) -> Column:
    return F.when(s.contains(" -> "), F.when(bracket != "", bracket).otherwise(after)).otherwise(s)


def _unwrapped(s: Column, inner: Column) -> Column:
    bracket = _bracket(inner)
    return F.when(s.contains("(") & s.rlike(_AGG), F.when(bracket != "", bracket).otherwise(inner)).otherwise(s)


def _agg_inner(s: Column) -> Column:
    return F.when(s.contains("("), F.regexp_extract(s, _AGG, 1)).when(s.isNotNull(), F.lit(""))


def _balanced(s: Column) -> Column:
    """Without trailing ')' that nothing opens."""
    n_close = F.length(s) - F.length(F.replace(s, F.lit(")"), F.lit("")))
    n_open = F.length(s) - F.length(F.replace(s, F.lit("("), F.lit("")))
    trailing = F.length(F.regexp_extract(s, r"(\)*)$", 1))
    cut = F.greatest(F.lit(0), F.least(trailing, n_close - n_open))
    return F.when(s.contains(")"), F.substring(s, F.lit(1), F.length(s) - cut)).otherwise(s)


def _drop_alias(s: Column) -> Column:
    """Without one or two digits at the end that follow another character ('$' also matches before a last line break)."""
    last = F.substring(s, -1, 1)
    long_number = (F.length(s) >= 3) & (F.translate(F.substring(s, -3, 3), "0123456789", "") == "")
    may_end = last.between("0", "9") & ~long_number | last.isin(*"\n\r\x85\u2028\u2029")
    return F.when(may_end, F.regexp_replace(s, r"(\D)(\d{1,2})$", "$1")).otherwise(s)


def clean_field_name(raw) -> Column:
    """Readable field name from a raw 'Role: name -> Entity[Field]' string.

    Steps, in order: drop the role prefix; take the right side of ' -> ' and
    the first bracket content in it; keep the last dotted part; unwrap an
    aggregate wrapper; drop trailing unbalanced ')'; drop a one- or two-digit
    alias suffix after a non-digit; strip whitespace.
    """
    steps = (
        _drop_well,
        lambda s: let(_after_arrow(s), lambda after: _resolved(s, after, _bracket(after))),
        lambda s: F.substring_index(s, ".", -1),
        lambda s: let(_agg_inner(s), lambda inner: _unwrapped(s, inner)),
        _balanced,
        _drop_alias,
    )
    s = col_of(raw).cast("string")
    for step in steps:
        s = let(s, step)
    return py_strip(s)


def is_technical_card(fields, title) -> Column:
    """A visual is technical when any cleaned field, or its title, is technical."""
    any_field = F.exists(col_of(fields), lambda f: is_technical(clean_field_name(f)))
    t = col_of(title)
    return F.coalesce(any_field, F.lit(False)) | (F.coalesce(t, F.lit("")) != "") & is_technical(t)


def with_clean_field_name(df, src: str, out: str):
    """P12 as chained projections: same result as ``clean_field_name``, fully code-generated.

    Each step reads the previous step's column; Catalyst keeps projections
    apart when a non-trivial value is reused, so nothing is recomputed and no
    higher-order function is needed.  Prefer this form on large tables.
    """
    t = [f"__cf{i}_{out}" for i in range(6)]
    s, tmp = F.col(t[0]), F.col(t[5])
    df = df.withColumn(t[0], F.col(src).cast("string"))
    df = df.withColumn(t[0], _drop_well(s))
    df = df.withColumn(t[5], _after_arrow(s))
    df = df.withColumn(t[1], _bracket(tmp))
    df = df.withColumn(t[2], F.substring_index(_resolved(s, tmp, F.col(t[1])), ".", -1))
    s = F.col(t[2])
    df = df.withColumn(t[5], _agg_inner(s))
    df = df.withColumn(t[3], _unwrapped(s, tmp))
    df = df.withColumn(t[4], _balanced(F.col(t[3])))
    df = df.withColumn(out, py_strip(_drop_alias(F.col(t[4]))))
    return df.drop(*t)
