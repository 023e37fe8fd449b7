"""Registered layout queries (J7, J8, W1, W2) with DuckDB oracles.

The J8 oracle walks each page in z order with a recursive CTE, keeping the
list of kept elements: the reference's sequential rule, evaluated directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcat.operators import crowded, layout
from fleetcat.operators.usage import visuals_with_page
from fleetcat.plans.registry import register
from fleetcat.sources.fixtures import catalog, oracle_ctes


def _visuals(spark, sf_dir, *columns):
    """Type and geometry of the visuals with their page's size, and ``columns`` (nothing else is shuffled and written)."""
    cat = catalog(spark, sf_dir, "cat_visuals", "cat_pages")
    v = visuals_with_page(cat["cat_visuals"], cat["cat_pages"])
    return v.select(*layout.PAGE_KEYS, "pos", "type", "x", "y", "width", "height", "z", "page_width", "page_height", *columns)


_V_SQL = """
, v AS (select v.model_id, v.page_id, v.pos, v.type, v.title, v.x, v.y, v.width, v.height, v.z,
          p.width as page_width, p.height as page_height,
          lower(v.type) in ('actionbutton', 'button', 'text', 'textbox') as absorbable
        from cat_visuals v join cat_pages p on v.model_id = p.model_id and v.page_id = p.page_id)
"""


@register("J7_overlap_pairs", oracle=oracle_ctes("cat_visuals", "cat_pages") + _V_SQL + """
select a.model_id, a.page_id, a.pos as pos_a, b.pos as pos_b,
  round((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))
        / least(a.width * a.height, b.width * b.height), 6) as ioa
from v a join v b on a.model_id = b.model_id and a.page_id = b.page_id and (a.z < b.z or (a.z = b.z and a.pos < b.pos))
where least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x) and least(a.y + a.height, b.y + b.height) > greatest(a.y, b.y)
  and least(a.width * a.height, b.width * b.height) > 0
""")
def j7_overlap(spark, sf_dir):
    p = layout.overlap_pairs(_visuals(spark, sf_dir))
    return p.select("model_id", "page_id", "pos_a", "pos_b", F.round("ioa", 6).alias("ioa"))


@register("J7_overlap_classes", oracle=oracle_ctes("cat_visuals", "cat_pages") + _V_SQL + """
, c AS (select model_id, page_id, x, y, width, height, min(pos) as pos, count(*) as members from v group by all)
select a.model_id, a.page_id, a.pos as class_a, b.pos as class_b, a.members as members_a, b.members as members_b,
  round((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))
        / least(a.width * a.height, b.width * b.height), 6) as ioa
from c a join c b on a.model_id = b.model_id and a.page_id = b.page_id and a.pos < b.pos
where least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x) and least(a.y + a.height, b.y + b.height) > greatest(a.y, b.y)
  and least(a.width * a.height, b.width * b.height) > 0
""")
def j7_classes(spark, sf_dir):
    pairs, members = crowded.overlap_classes(_visuals(spark, sf_dir))
    sizes = members.groupBy(*layout.PAGE_KEYS, "class_pos").agg(F.count(F.lit(1)).alias("n"))
    for side in ("a", "b"):
        pairs = pairs.join(sizes.withColumnsRenamed({"class_pos": f"class_{side}", "n": f"members_{side}"}), [*layout.PAGE_KEYS, f"class_{side}"])
    return pairs.select("model_id", "page_id", "class_a", "class_b", "members_a", "members_b", F.round("ioa", 6).alias("ioa"))


_IOA = """(case when least(k.x + k.w, o.x + o.width) < greatest(k.x, o.x) or least(k.y + k.h, o.y + o.height) < greatest(k.y, o.y) then 0
     when least(k.w * k.h, o.width * o.height) = 0 then 0
     else (least(k.x + k.w, o.x + o.width) - greatest(k.x, o.x)) * (least(k.y + k.h, o.y + o.height) - greatest(k.y, o.y))
          / least(k.w * k.h, o.width * o.height) end)"""

_WALK_SQL = _V_SQL + f"""
, o AS (select *, row_number() over (partition by model_id, page_id order by z, pos) as rn from v),
walk(model_id, page_id, rn, kept) AS (
  select model_id, page_id, cast(0 as bigint), cast([] as struct(pos bigint, x double, y double, w double, h double)[])
  from (select distinct model_id, page_id from o)
  union all
  select w.model_id, w.page_id, w.rn + 1,
    case when o.absorbable and len(list_filter(w.kept, lambda k: {_IOA} >= 0.95)) > 0 then w.kept
         else list_append(w.kept, struct_pack(pos := o.pos, x := o.x, y := o.y, w := o.width, h := o.height)) end
  from walk w join o on o.model_id = w.model_id and o.page_id = w.page_id and o.rn = w.rn + 1),
final AS (select model_id, page_id, arg_max(kept, rn) as kept from walk group by model_id, page_id),
kept_pos AS (select model_id, page_id, unnest(kept).pos as pos from final),
cons AS (select v.*, k.pos is null as absorbed from v left join kept_pos k
         on v.model_id = k.model_id and v.page_id = k.page_id and v.pos = k.pos)
"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_J8_SQL = _recursive(oracle_ctes("cat_visuals", "cat_pages") + _WALK_SQL + "select model_id, page_id, pos, absorbed from cons")


@register("J8_consolidate_layers", oracle=_J8_SQL)
def j8_consolidate(spark, sf_dir):
    return layout.consolidate_layers(_visuals(spark, sf_dir)).select("model_id", "page_id", "pos", "absorbed")


@register("J8_consolidate_crowded", oracle=_J8_SQL)
def j8_crowded(spark, sf_dir):
    return crowded.consolidate_crowded(_visuals(spark, sf_dir)).select("model_id", "page_id", "pos", "absorbed")


@register("W1_W2_wireframe", oracle=_recursive(oracle_ctes("cat_visuals", "cat_pages") + _WALK_SQL + """
, kept AS (select * from cons where not absorbed),
lab AS (select *, case when coalesce(title, '') = '' then type else title end as raw,
          cast(trunc(width / 11) as bigint) as budget,
          case when (case when coalesce(page_width, 0) <> 0 and coalesce(page_height, 0) <> 0
                          then width * height / (page_width * page_height) else 0 end) > 0.70 then 'background'
               when lower(type) in ('button', 'slicer', 'shape', 'textbox', 'actionbutton') then 'control' else 'data' end as layer
        from kept)
select model_id, page_id, pos,
  cast(row_number() over (partition by model_id, page_id order by z, pos) as integer) as z_number,
  cast((row_number() over (partition by model_id, page_id, round_even(x / 6, 0), round_even(y / 6, 0) order by z, pos) - 1) * 20
       as integer) as badge_offset,
  layer,
  case when layer = 'background' or budget < 4 then null when length(raw) <= budget then raw
       else substring(raw, 1, budget - 1) || '…' end as label
from lab
"""))
def w1_w2_wireframe(spark, sf_dir):
    return layout.wireframe(layout.consolidate_layers(_visuals(spark, sf_dir, "title")))
