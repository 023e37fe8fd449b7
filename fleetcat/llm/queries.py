"""Registered queries of the training-data operators (and their SQL, where SQL can express them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcat.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# word pattern and A-Z lower-casing of the contracts, in DuckDB
_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


_NEAR_SQL = f"""
with recursive w as (
  select doc_id, {_WORDS.format(_LOWER.format("text"))} as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    when len(w) = 1 then w else cast([] as varchar[]) end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as s from s),
p as (
  select a.doc_id as u, b.doc_id as v from x a join x b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r as (select doc_id as u, doc_id as v from documents union select r.u, p.v from r join p on p.u = r.v),
c as (select u as doc_id, min(v) as component_id from r group by u)
select s.doc_id, cast(coalesce(len(s.s), 0) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join c on c.doc_id = s.doc_id"""


@register("op8_minhash_near_dedup", _NEAR_SQL)
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op8 import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2, threshold=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_LEAK_SQL = f"""
with b as (select item_id, {_WORDS.format(_LOWER.format("text"))} as w from benchmark),
d as (select doc_id, {_WORDS.format(_LOWER.format("text"))} as w from documents),
k as (select distinct least(len(w), 5) as k from b where len(w) > 0),
bs as (select distinct item_id, least(len(w), 5) as k,
  unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) as s from b where len(w) > 0),
ds as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s
  from d join k on len(w) >= k),
n as (select item_id, count(*) as n_item from bs group by item_id),
h as (select doc_id, item_id, count(*) as n_shared from ds join bs using (k, s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) as containment
from h join n using (item_id) where 100 * n_shared >= 80 * n_item"""


@register("op1_benchmark_decontamination", _LEAK_SQL)
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op1 import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op5_token_id_output")
def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fleetcat.llm.op5 import read_documents, write_tokens

    docs = read_table(spark, sf_dir, "documents")
    return read_documents(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


_MIX_SQL = f"""
with r as (
  select doc_id, source, md5(concat_ws('|', 'mix-7', cast(doc_id as varchar), text)) as k,
    cast(coalesce(len({_WORDS.format("text")}), 0) as bigint) as size from documents),
p as (select *, coalesce(sum(size) over (partition by source order by k, size rows between unbounded preceding and 1 preceding), 0) as before from r),
s as (select source, cast(sum(size) as bigint) as source_size from r group by source),
w as (select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 3.0e0 when 1 then 1.0e0 else 2.0e0 end as weight,
    source_size * 2.0e0 as cap from s),
v as (select *, (sum(cast(source_size as double)) over () * 1.5e0
      - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0.0e0))
    / sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as level from w),
f as (select *, cap <= weight * level as capped from v),
g as (select *, max(case when not capped then level end) over () as free from f),
t as (select source, source_size, case when capped then cap else weight * free end as target from g),
q as (select *, cast(floor(round(target, 6)) as bigint) as budget from t),
z as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from q)
select p.doc_id, p.size, z.source_size, round(z.target, 6) as target,
  cast(z.epochs * p.size + least(p.size, greatest(z.budget - z.epochs * z.source_size - p.before, 0)) as bigint) as taken
from p join z on p.source is not distinct from z.source"""


@register("op7_mix_to_target_weights", _MIX_SQL)
def op7_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op7 import mix

    return mix(read_table(spark, sf_dir, "documents"))


@register("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op3 import score_documents, train

    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))


@register("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op4 import judge, train

    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, train(docs, read_table(spark, sf_dir, "labels")))


@register("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op10 import score_documents, train

    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, *train(docs))


@register("op6_url_filters")
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op6 import judge, rules_table

    return judge(read_table(spark, sf_dir, "pages"), rules_table(spark))


_CHAT_SQL = """
with a as (
  select conv_id, turn, text, 'call_' || conv_id || '_' || turn as call_id,
    case turn % 3 when 0 then 'search' when 1 then 'lookup' else 'summarise' end as name, length(text) % 10 as lim
  from conversations where role = 'assistant'),
r as (select conv_id, turn, text, 'call_' || conv_id || '_' || (turn - 1) as call_id from conversations where role = 'user' and turn >= 2),
j as (
  select coalesce(a.conv_id, r.conv_id) as conv_id, coalesce(a.call_id, r.call_id) as call_id, a.name, a.turn as call_turn, r.turn as result_turn,
    a.text as q, r.text as res, a.lim, a.call_id is null as orphan
  from a full join r on a.conv_id = r.conv_id and a.call_id = r.call_id),
v as (select j.*, case when orphan then null else 0 end as level from j)
select conv_id, call_id, name, cast(level as integer) as level,
  cast(row_number() over (partition by conv_id order by orphan, coalesce(call_turn, result_turn)) - 1 as bigint) as position,
  call_turn, result_turn,
  case when orphan then 'orphan result' when result_turn is null then 'no result' when q = '' or lim = 0 then 'invalid arguments' else 'ok' end as status,
  (case when not orphan and lim = 0 then 1 else 0 end) + (case when not orphan and q = '' then 1 else 0 end) as n_errors,
  case when orphan then '{"id":' || to_json(call_id) || ',"result":' || to_json(res) || '}'
  else '{"arguments":{' || case when call_turn >= 3 then '"after":"{{call_' || conv_id || '_' || (call_turn - 2) || '}}",' else '' end
    || '"limit":' || lim || ',"query":' || to_json(q) || '},"id":' || to_json(call_id) || ',"name":' || to_json(name)
    || ',"result":' || coalesce(cast(to_json(res) as varchar), 'null') || '}' end as record
from v"""


@register("op9_chat_tool_linking", _CHAT_SQL)
def op9_chat_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op9 import TOOLS, conversation_calls, linked_calls

    rows = linked_calls(conversation_calls(read_table(spark, sf_dir, "conversations")), TOOLS)
    return rows.withColumn("n_errors", F.size("errors")).drop("errors")


def _licence_sql() -> str:
    from fleetcat.llm.op2 import LICENCE_NAMES, TEMPLATES, TERM, THRESHOLD

    low = _LOWER.format("{0}")
    terms = f"regexp_extract_all({low}, '{TERM}')"
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    return f"""
with temp as (select * from (values {values}) as v(tid, licence, body)),
tt as (select tid, licence, term, count(*) as tf from (select tid, licence, unnest({terms.format("body")}) as term from temp) group by all),
f as (select doc_id, text, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' as top, cast(doc_id // 100 as varchar) || '/' as h, cast(doc_id // 10 as varchar) || '/' as t from documents),
p as (select doc_id, text, case when doc_id % 1000 = 0 then top || 'LICENSE' when doc_id % 100 = 0 then top || h || 'LICENSE' when doc_id % 10 = 0 then top || h || t || 'LICENSE'
  else top || h || t || 'doc_' || doc_id || '.txt' end as path from f),
files as (select *, regexp_extract(path, '^((?:[^/]*/)*)[^/]*$', 1) as folder, regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '{LICENCE_NAMES}') as lf from p),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from files where text is not null),
worded as (select row_number() over () as k, line from lines where length(trim(line, ' ')) > 0),
vocab as (select distinct term from tt),
df as (select term, count(*) as df from (select distinct k, unnest({terms.format("line")}) as term from worded) where term in (select term from vocab) group by term),
n as (select count(*) as n from worded),
idf as (select term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 as idf from vocab left join df using (term), n),
tw as (select tid, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by tid)) as w from tt join idf using (term)),
seg as (select row_number() over () as k, doc_id, s from (select doc_id, line as s from lines union all select doc_id, text from files where lf and text is not null)),
st as (select k, doc_id, term, count(*) as tf from (select k, doc_id, unnest({terms.format("s")}) as term from seg) group by all),
sv as (select k, doc_id, term, tf * coalesce(idf, ln(n + 1) + 1) as w from st left join idf using (term), n),
sn as (select k, sqrt(sum(w * w)) as norm from sv group by k),
cs as (select sv.k, sv.doc_id, tid, licence, round(sum(sv.w * tw.w) / any_value(norm), 6) as score from sv join tw using (term) join sn on sn.k = sv.k group by sv.k, sv.doc_id, tid, licence),
own as (select doc_id, licence, score from cs where score >= {THRESHOLD} qualify row_number() over (partition by doc_id order by score desc, licence) = 1),
dirs as (select folder, licence from files join own using (doc_id) where lf qualify row_number() over (partition by folder order by score desc, licence, path) = 1),
up as (select distinct a.folder, d.folder as above, d.licence from (select distinct folder from files) a join dirs d on starts_with(a.folder, d.folder)),
near as (select * from up qualify row_number() over (partition by folder order by length(above) desc) = 1)
select files.doc_id, path, own.licence as own_licence, own.score, coalesce(own.licence, near.licence) as licence,
  case when own.licence is not null and lf then 'licence file' when own.licence is not null then 'header' when near.licence is not null then 'inherited' else 'none' end as origin,
  case when own.licence is null then near.above end as licence_folder
from files left join own using (doc_id) left join near on near.folder = files.folder"""


@register("op2_license_scan", _licence_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op2 import document_files, scan

    return scan(document_files(read_table(spark, sf_dir, "documents")), windows=True).withColumnRenamed("file_id", "doc_id")


def _merkle_sql(levels: int = 9, upper_levels: int = 4) -> str:
    """Trees of up to 8^levels leaves and 8^upper_levels groups, one pair of table expressions per level."""
    def field(c):
        return f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"

    def tree(prefix, n):
        out = []
        for k in range(n):
            run = "over (partition by grp, pos // 8 order by pos rows between"
            out.append(f"""{prefix}x{k} as (select *, case when n = 1 then null else coalesce(string_agg(d, '') {run} unbounded preceding and 1 preceding), '') end as l,
    case when n = 1 then null else coalesce(string_agg(d, '') {run} 1 following and unbounded following), '') end as r from {prefix}{k})""")
            out.append(f"""{prefix}{k + 1} as (select grp, pos // 8 as pos, (any_value(n) + 7) // 8 as n,
    case when any_value(n) = 1 then any_value(d) else sha256(string_agg(d, '' order by pos)) end as d from {prefix}{k} group by grp, pos // 8)""")
        return ",\n".join(out)

    def fold(prefix, n, start):
        """One table expression per level: the siblings so far and the two nodes as folded so far."""
        out = []
        for k in range(n):
            out.append(f"""{prefix}f{k + 1} as (select f.* exclude (proof, o), proof || coalesce(x.l || x.r, '') as proof,
    case when x.l is null then o else sha256(x.l || o || x.r) end as o
  from {start if k == 0 else f"{prefix}f{k}"} f join {prefix}x{k} x on x.grp is not distinct from f.{prefix}grp and x.pos = f.{prefix}pos // {8 ** k})""")
        return ",\n".join(out)

    leaf = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)"
    # crc32 keeps its low byte apart from the rest, so each byte of the decimal id is one reduction over its bits
    crc = ("xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ord(ch) as bigint))), "
           f"lambda c, b: {bit}))")
    return f"""
with d as (select doc_id, lang, text, case when {crc} % 3 = 0 then {_LOWER.format("text")} else text end as later, {leaf} as head from documents),
h as (select doc_id, lang as grp, sha256(head || {field("text")}) as d, sha256(head || {field("later")}) as o from d),
leaves as (select *, row_number() over (partition by grp order by doc_id nulls first, d, o) - 1 as pos, count(*) over (partition by grp) as n from h),
a0 as (select grp, pos, n, d from leaves),
{tree("a", levels)},
u as (select grp as lang, d, row_number() over (order by grp nulls first) - 1 as pos, count(*) over () as n from a{levels}),
b0 as (select 0 as grp, pos, n, d from u),
{tree("b", upper_levels)},
start as (select l.doc_id, l.d as leaf, u.d as subroot, l.grp as agrp, l.pos as apos, 0 as bgrp, u.pos as bpos, '' as proof, l.o from leaves l join u on u.lang is not distinct from l.grp),
{fold("a", levels, "start")},
{fold("b", upper_levels, f"af{levels}")}
select f.doc_id, f.leaf, f.subroot, t.d as root, sha256(f.proof) as proof_sha256, f.o as folded_root, f.o = t.d as verified
from bf{upper_levels} f cross join b{upper_levels} t"""


@register("op11_merkle_manifest", _merkle_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op11 import build, folded, proof_text

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, F.translate("text", upper, lower)).otherwise(F.col("text"))
    rows = build(read_table(spark, sf_dir, "documents"), changed={"text": tampered})
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
                       folded(F.col("other_leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@register("op12_html_extraction")
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op12 import extract

    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


_FIM_SQL = """
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
h as (select *, cast(len(u) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
  cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
    when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end)
    as output_sha256, sha256(text) as restored_sha256
from p"""


@register("op13_fill_in_middle", _FIM_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetcat.llm.op13 import fill_in_middle, restored

    rows = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
