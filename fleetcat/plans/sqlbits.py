"""DuckDB SQL fragments for the oracles (same rules as the Spark builders)."""

from __future__ import annotations

from fleetcat.functions.names import AGG_WRAPPERS, SYSTEM_TABLE_PREFIXES, WELL_LABELS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def is_system(col: str) -> str:
    ors = " or ".join(f"starts_with({col}, {q(p)})" for p in SYSTEM_TABLE_PREFIXES)
    return f"coalesce({ors}, false)"


def pystrip(expr: str) -> str:
    # the code points spelled out once more, as literal characters: the oracle does not share the engine's class
    space = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    return f"trim({expr}, '{space}')"


_WELL_ALT = "|".join(w for w, _ in WELL_LABELS)
ALIAS_SUFFIX = r"(\D)(\d{1,2})$"


def clean_field(col: str, out: str, tag: str = "cf") -> str:
    """P12 in DuckDB as a run of select items; each step reuses the previous alias.

    Append the result to a SELECT list; the final value is aliased ``out``.
    """
    p = f"_{tag}_"
    agg = f"(?i)^(?:{'|'.join(AGG_WRAPPERS)})\\((.+)\\)$"
    items = [
        f"regexp_replace({col}, '^({_WELL_ALT}): ', '') as {p}1",
        f"string_split({p}1, ' -> ')[-1] as {p}res",
        f"coalesce(regexp_extract({p}res, '\\[([^\\]]+)\\]', 1), '') as {p}br",
        f"(case when contains({p}1, ' -> ') then (case when {p}br <> '' then {p}br else {p}res end) else {p}1 end) as {p}2",
        f"(case when contains({p}2, '.') then string_split({p}2, '.')[-1] else {p}2 end) as {p}3",
        f"coalesce(regexp_extract({p}3, {q(agg)}, 1), '') as {p}in",
        f"coalesce(regexp_extract({p}in, '\\[([^\\]]+)\\]', 1), '') as {p}inbr",
        f"(case when regexp_matches({p}3, {q(agg)}) then (case when {p}inbr <> '' then {p}inbr else {p}in end) else {p}3 end) as {p}4",
        f"greatest(0, least(length(coalesce(regexp_extract({p}4, '(\\)*)$', 1), '')), "
        f"(length({p}4) - length(replace({p}4, ')', ''))) - (length({p}4) - length(replace({p}4, '(', ''))))) as {p}cut",
        f"substring({p}4, 1, length({p}4) - {p}cut) as {p}5",
        f"regexp_replace({p}5, {q(ALIAS_SUFFIX)}, '\\1') as {p}6",
        f"{pystrip(p + '6')} as {out}",
    ]
    return ", ".join(items)


def case_map(col: str, pairs, default: str | None = None) -> str:
    """CASE col WHEN k THEN v ... ELSE default (or col) END."""
    whens = " ".join(f"when {q(k)} then {q(v)}" for k, v in pairs)
    return f"(case {col} {whens} else {default or col} end)"


def escape_html(col: str) -> str:
    """P6 in DuckDB: unquoted key=value redaction, then the five HTML escapes."""
    from fleetcat.functions.text import ESCAPE_REDACT
    s = f"regexp_replace(cast({col} as varchar), {q(ESCAPE_REDACT)}, '\\1***', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = f"replace({s}, {q(a)}, {q(b)})"
    return f"coalesce({s}, '')"


def visual_label(col: str) -> str:
    from fleetcat.functions.names import VISUAL_LABELS
    return case_map(col, VISUAL_LABELS)


def visual_description(type_col: str, title_col: str) -> str:
    return (f"({visual_label(type_col)} || case when coalesce({title_col}, '') <> '' "
            f"then ' \"' || {escape_html(title_col)} || '\"' else '' end)")


def field_ref_sql(j: str) -> str:
    """P22 in DuckDB: a field JSON text -> 'table[field]', 'Agg(...)' or 'HierarchyLevel(...)'."""
    return """(case when json_extract({j}, '$.Aggregation') is not null then
         'Agg(' || case when json_extract({j}, '$.Aggregation.Expression.Measure') is not null then
                  coalesce(json_extract_string({j}, '$.Aggregation.Expression.Measure.Expression.SourceRef.Entity'), '') || '['
                  || coalesce(json_extract_string({j}, '$.Aggregation.Expression.Measure.Property'), '') || ']'
                when json_extract({j}, '$.Aggregation.Expression.Column') is not null then
                  coalesce(json_extract_string({j}, '$.Aggregation.Expression.Column.Expression.SourceRef.Entity'), '') || '['
                  || coalesce(json_extract_string({j}, '$.Aggregation.Expression.Column.Property'), '') || ']'
                else '' end || ')'
       when json_extract({j}, '$.Measure') is not null then
         coalesce(json_extract_string({j}, '$.Measure.Expression.SourceRef.Entity'), '') || '[' || coalesce(json_extract_string({j}, '$.Measure.Property'), '') || ']'
       when json_extract({j}, '$.Column') is not null then
         coalesce(json_extract_string({j}, '$.Column.Expression.SourceRef.Entity'), '') || '[' || coalesce(json_extract_string({j}, '$.Column.Property'), '') || ']'
       when json_extract({j}, '$.HierarchyLevel') is not null then
         'HierarchyLevel(' || coalesce(json_extract_string({j}, '$.HierarchyLevel.Level'), '') || ')'
       else '' end)""".replace("{j}", j)
