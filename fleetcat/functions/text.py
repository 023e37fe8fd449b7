"""Redaction, escaping, labels, geometry and hashing scalars.

P5, P6, P7, P17, P18, P20, P21, P22, P27; all Catalyst expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetcat.functions.common import col_of

# Fixed values that must equal the reference's rules.
# Secret keys for log redaction (P5) and for escaped output (P6):
SECRET_KEYS = ("key", "apikey", "api_key", "token", "password", "pwd", "secret", "sig", "access_token")
# Sensitive-string redaction for exported definitions (P7), applied in this order:
SENSITIVE_RULES = (
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
    (r"\b(?:[a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4}\b", "[REDACTED_IPV6]"),
    (r"""(Sql\.Database\()\s*['"][^'"]+['"]\s*,\s*['"][^'"]+['"]""", '$1"[REDACTED_SERVER]", "[REDACTED_DB]"'),
    (r"""(SapHana\.Database\()\s*['"][^'"]+['"]""", '$1"[REDACTED_HANA]"'),
    (r"""(Oracle\.Database\()\s*['"][^'"]+['"]""", '$1"[REDACTED_ORACLE]"'),
    (r"""(OData\.Feed\()\s*['"][^'"]+['"]""", '$1"[REDACTED_URL]"'),
    (r"""(Web\.Contents\()\s*['"][^'"]+['"]""", '$1"[REDACTED_URL]"'),
    (r"""(?i)(password|token|secret|key)\s*=\s*['"][^'"]+['"]""", '$1="[REDACTED]"'),
)
# Layout rules: label width budget, background share, control types.
PX_PER_CHAR = 11
MIN_LABEL_CHARS = 4
BACKGROUND_AREA_SHARE = 0.70
CONTROL_TYPES = ("button", "slicer", "shape", "textbox", "actionbutton")

_KEYS = "|".join(SECRET_KEYS)
# Unquoted key=value pattern redacted before HTML escaping (P6):
ESCAPE_REDACT = rf"(?i)(({_KEYS})\s*=\s*)([^&\"'\s\\]+)"


def redact_secrets(text) -> Column:
    """P5: ``key=value`` / ``key: 'value'`` -> ``key=***`` keeping the quotes."""
    pattern = rf"(?i)({_KEYS})\s*[=:]\s*(['\"]?)[^\s'\"&]+(\2)"
    return F.regexp_replace(col_of(text), pattern, "$1=$2***$3")


def escape_html(text) -> Column:
    """Redact unquoted ``key=value`` then HTML-escape; null -> ''."""
    s = col_of(text).cast("string")
    s = F.when(s.contains("="), F.regexp_replace(s, ESCAPE_REDACT, "$1***")).otherwise(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.coalesce(s, F.lit(""))


def redact_sensitive(text) -> Column:
    """IPs, connector arguments and quoted credentials, in the fixed order."""
    s = col_of(text)
    for pattern, repl in SENSITIVE_RULES:
        s = F.regexp_replace(s, pattern, repl)
    return s


def fit_label(text, width) -> Column:
    """Label cut to the width budget; null when fewer than 4 characters fit."""
    t = col_of(text)
    budget = (col_of(width) / PX_PER_CHAR).cast("long")
    return (F.when(budget < MIN_LABEL_CHARS, F.lit(None).cast("string"))
            .when(F.length(t) <= budget, t)
            .otherwise(F.concat(F.substring(t, F.lit(1), (budget - 1).cast("int")), F.lit("…"))))


def is_control(vtype) -> Column:
    return F.lower(col_of(vtype)).isin(*CONTROL_TYPES)


def area_ratio(width, height, page_width, page_height) -> Column:
    pw, ph = col_of(page_width), col_of(page_height)
    return F.when((F.coalesce(pw, F.lit(0)) != 0) & (F.coalesce(ph, F.lit(0)) != 0),
                  col_of(width) * col_of(height) / (pw * ph)).otherwise(F.lit(0.0))


def layer_of(vtype, width, height, page_width, page_height) -> Column:
    """P18: 'background' above 70% of the page, 'control' for control types, else 'data'."""
    return (F.when(area_ratio(width, height, page_width, page_height) > BACKGROUND_AREA_SHARE, F.lit("background"))
            .when(is_control(vtype), F.lit("control"))
            .otherwise(F.lit("data")))


def model_fingerprint(source_name, n_measures, n_tables) -> Column:
    """P20: first 8 hex characters of SHA-256 of 'name_measures_tables'."""
    return F.substring(F.sha2(F.concat_ws("_", col_of(source_name).cast("string"),
                                          col_of(n_measures).cast("string"),
                                          col_of(n_tables).cast("string")), 256), 1, 8)


def error_hash(stage, error_type) -> Column:
    """Upper-cased first 8 hex characters of SHA-1 of 'type:stage'."""
    return F.upper(F.substring(F.sha1(F.concat_ws(":", col_of(error_type), col_of(stage))), 1, 8))


def error_code(stage, error_type, prefix: str = "ERR") -> Column:
    """P21: '<prefix>-<stage>-<hash>'."""
    return F.concat_ws("-", F.lit(prefix), col_of(stage), error_hash(stage, error_type))


def _may_hold(text: Column, key: str) -> Column:
    """False only where JSON text cannot hold the key; spares parsing the text to find that out."""
    return text.contains(key) | text.contains("\\")  # an escape may spell any key


def _ref_of(json_col: Column, path: str) -> Column:
    """One level of a field reference: Measure/Column -> 'table[prop]', Aggregation -> 'Agg(...)'."""
    g = lambda p: F.get_json_object(json_col, f"{path}.{p}")
    has = lambda p: _may_hold(json_col, p) & g(p).isNotNull()
    return (F.when(has("Measure"),
                   F.concat(F.coalesce(g("Measure.Expression.SourceRef.Entity"), F.lit("")), F.lit("["),
                            F.coalesce(g("Measure.Property"), F.lit("")), F.lit("]")))
            .when(has("Column"),
                  F.concat(F.coalesce(g("Column.Expression.SourceRef.Entity"), F.lit("")), F.lit("["),
                           F.coalesce(g("Column.Property"), F.lit("")), F.lit("]")))
            .when(has("SourceRef"), F.coalesce(g("SourceRef.Entity"), F.lit("")))
            .when(has("HierarchyLevel"),
                  F.concat(F.lit("HierarchyLevel("), F.coalesce(g("HierarchyLevel.Level"), F.lit("")), F.lit(")")))
            .otherwise(F.lit("")))


def field_reference(field_json) -> Column:
    """A field JSON -> 'table[field]', 'Agg(table[field])' or 'HierarchyLevel(level)'."""
    j = col_of(field_json)
    agg_inner = _ref_of(j, "$.Aggregation.Expression")
    top = _ref_of(j, "$")
    return F.when(_may_hold(j, "Aggregation") & F.get_json_object(j, "$.Aggregation").isNotNull(),
                  F.concat(F.lit("Agg("), agg_inner, F.lit(")"))).otherwise(top)


def format_geometry(vtype, title, x, y, width, height, z) -> Column:
    """P27: 'W×H @ X,Y (Z: z)' with values rounded down, and the title defaulting to the type."""
    i = lambda c: col_of(c).cast("long").cast("string")  # noqa: E731  (truncates like int())
    t = col_of(title)
    label = F.when(F.coalesce(t, F.lit("")) == "", col_of(vtype)).otherwise(t)
    return F.struct(
        label.alias("label"),
        F.concat(i(width), F.lit("×"), i(height), F.lit(" @ "), i(x), F.lit(","), i(y)).alias("geometry"),
        i(z).alias("z_text"),
    )


# Parsed form of a field reference, for scans that read whole documents with from_json (one parse per document).
_REF = "struct<Expression: struct<SourceRef: struct<Entity: string>>, Property: string>"
_LEAF = f"Measure: {_REF}, Column: {_REF}, SourceRef: struct<Entity: string>, HierarchyLevel: struct<Level: string>"
FIELD_SCHEMA = f"struct<{_LEAF}, Aggregation: struct<Expression: struct<{_LEAF}>>>"


def _ref_of_struct(s: Column) -> Column:
    def named(x: Column) -> Column:
        return F.concat(F.coalesce(x["Expression"]["SourceRef"]["Entity"], F.lit("")), F.lit("["),
                        F.coalesce(x["Property"], F.lit("")), F.lit("]"))
    return (F.when(s["Measure"].isNotNull(), named(s["Measure"]))
            .when(s["Column"].isNotNull(), named(s["Column"]))
            .when(s["SourceRef"].isNotNull(), F.coalesce(s["SourceRef"]["Entity"], F.lit("")))
            .when(s["HierarchyLevel"].isNotNull(),
                  F.concat(F.lit("HierarchyLevel("), F.coalesce(s["HierarchyLevel"]["Level"], F.lit("")), F.lit(")")))
            .otherwise(F.lit("")))


def field_reference_struct(field: Column) -> Column:
    """P22 on a field already parsed with ``FIELD_SCHEMA`` (same result as ``field_reference`` on its text)."""
    return F.when(field["Aggregation"].isNotNull(),
                  F.concat(F.lit("Agg("), _ref_of_struct(field["Aggregation"]["Expression"]), F.lit(")"))
                  ).otherwise(_ref_of_struct(field))
