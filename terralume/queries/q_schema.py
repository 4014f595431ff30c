"""Identity and drift on schema tables derived from orders, lines and parts.

An order is a received layer whose fields are the names of its parts; a part
type is a known dataset whose fields are the names of its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import conform, drift, identity
from ..specs import Dataset, parse_fields
from . import roles
from .registry import query, table


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    li, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    fields = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.upper("p_name"))).alias("campos")
    )
    kind = F.when(F.col("o_orderstatus") == "F", "Polygon").when(F.col("o_orderstatus") == "O", "MultiPolygon").otherwise("Point")
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "camada ECONOMY 2024").otherwise(F.col("o_orderpriority"))
    return o.join(fields, o.o_orderkey == fields.l_orderkey).select(
        F.col("o_orderkey").alias("layer"), name.alias("nome"), kind.alias("geometria"), "campos",
        F.md5(F.array_join("campos", ",")).alias("assinatura"), "o_custkey", "o_orderpriority",
    )


def _specs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    fields = p.groupBy(F.col("p_type").alias("dataset"), F.col("p_name").alias("campo")).agg(
        (F.min("p_size") <= 1).alias("obrigatorio")
    )
    alias = F.when(F.length("campo") > 9, F.left("campo", F.lit(9))).otherwise(F.col("campo"))
    specs = fields.select("dataset", "campo", alias.alias("alias"), F.lit(0).alias("ordem"), "obrigatorio")
    profiles = p.groupBy(F.col("p_type").alias("dataset")).agg(
        F.array(F.lit("polygon")).alias("familias"),
        F.array(F.col("p_type")).alias("tokens"),
        F.array(F.min("p_name"), F.max("p_name")).alias("sinais"),
    )
    return specs, profiles


_SCHEMA_SQL = """
lf as (select distinct l_orderkey as layer, lower(replace(p_name, ' ', '_')) as h from lineitem join part on l_partkey = p_partkey),
layers as (select o_orderkey as layer, o_custkey, case when o_orderpriority = '1-URGENT' then 'camada ECONOMY 2024' else o_orderpriority end as nome, o_orderstatus <> 'P' as geo
  from orders where o_orderkey in (select layer from lf)),
specs as (select p_type as dataset, p_name as campo, lower(replace(trim(case when length(p_name) > 9 then left(p_name, 9) else p_name end), ' ', '_')) as w, min(p_size) <= 1 as req from part group by 1, 2, 3),
hits as (select distinct layer, dataset, campo, req from lf join specs on h = w or (least(length(h), length(w)) >= 8 and (starts_with(h, w) or starts_with(w, h)))),
sizes as (select dataset, count(*) as total, count(*) filter (req) as need, lower(replace(min(campo), ' ', '_')) as s1, lower(replace(max(campo), ' ', '_')) as s2 from specs group by 1),
mapped as (select layer, dataset, count(*) as m, count(*) filter (req) as r from hits group by 1, 2),
signals as (select dataset, s1 as s from sizes union select dataset, s2 from sizes),
shits as (select distinct layer, dataset, s from lf join signals on h = s or (least(length(h), length(s)) >= 8 and (starts_with(h, s) or starts_with(s, h)))),
sm as (select layer, dataset, count(*) as k from shits group by 1, 2),
evidence as (select coalesce(mapped.layer, sm.layer) as layer, coalesce(mapped.dataset, sm.dataset) as dataset, coalesce(m, 0) as m, coalesce(r, 0) as r, coalesce(k, 0) as k
  from mapped full join sm on mapped.layer = sm.layer and mapped.dataset = sm.dataset),
scored as (select layer, dataset, geo, r = need as req_ok, m, k,
    contains('_' || trim(regexp_replace(lower(nome), '[^a-z0-9]+', '_', 'g'), '_') || '_', '_' || lower(dataset) || '_') as tok, total, need
  from evidence join sizes using (dataset) join layers using (layer)),
scores as (select layer, dataset, geo as geometria_ok, req_ok as obrigatorio_ok, m as mapeados, k::int as sinais_ok, tok::int as tokens_ok,
    case when geo then 3 else 0 end + case when req_ok and need > 0 then 3 else 0 end + least(m, 4) + least(k, 3) as estrutura, total from scored)
"""


@query(
    "D1 P2 J21",
    sql=f"""with {_SCHEMA_SQL}
    select layer, dataset, geometria_ok, obrigatorio_ok, mapeados, sinais_ok, tokens_ok, estrutura::int as estrutura, (estrutura + 3 * tokens_ok)::int as pontos, round(mapeados / total, 4) as cobertura from scores""",
)
def layer_scores(spark: SparkSession, sf: str) -> DataFrame:
    return identity.score_layers(_layers(spark, sf), *_specs(spark, sf))


@query(
    "D2",
    sql=f"""with {_SCHEMA_SQL}, fit as (select s.*, estrutura + 3 * tokens_ok as pontos, mapeados / total as cob, o_custkey as pacote from scores s join layers using (layer) where geometria_ok),
    c as (select * from (select *, bool_or(obrigatorio_ok) over (partition by pacote, dataset) as any_ok from fit) where obrigatorio_ok or not any_ok),
    r as (select *, row_number() over w as rn, lead(pontos) over w as p2, lead(estrutura) over w as e2, lead(tokens_ok) over w as t2, lead(mapeados) over w as m2
      from c window w as (partition by pacote, dataset order by pontos desc, estrutura desc, tokens_ok desc, mapeados desc, round(cob, 4) desc, layer))
    select pacote, dataset, layer, case when p2 is null then 'CAMADA_UNICA' when pontos >= p2 + 2 or (tokens_ok > 0 and t2 = 0) or mapeados >= m2 + 2 or estrutura >= e2 + 2 then 'MELHOR_ASSINATURA_ESTRUTURAL' else 'AMBIGUO' end as criterio
    from r where rn = 1""",
)
def layer_selection(spark: SparkSession, sf: str) -> DataFrame:
    """All layers a customer sent are one package."""
    layers = _layers(spark, sf)
    scores = identity.score_layers(layers, *_specs(spark, sf))
    package = layers.select("layer", F.col("o_custkey").alias("pacote"))
    return identity.select_layers(scores, package).select("pacote", "dataset", "layer", "criterio")


@query("D3 D10")
def identity_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Each layer against the dataset its sender chose; history from the sender's own last layer."""
    layers = _layers(spark, sf)
    scores = identity.score_layers(layers, *_specs(spark, sf))
    kinds = F.array(*[F.lit(t) for t in ("ECONOMY", "STANDARD", "PROMO")])
    wanted = layers.select("layer", F.get(kinds, (F.col("o_custkey") % 3).cast("int")).alias("dataset"))
    first = layers.groupBy("o_custkey").agg(
        F.min_by(F.struct("campos", "geometria", "assinatura"), "layer").alias("h")
    )
    compared = layers.join(first, "o_custkey").select(
        "layer",
        (F.col("assinatura") == F.col("h.assinatura")).alias("exato"),
        identity.compatible_structure(
            F.col("h.campos"), F.col("campos"), F.col("h.geometria"), F.col("geometria")
        ).alias("compativel"),
    )
    return identity.decide_identity(scores, wanted, compared)


@query("D4 D6")
def file_classification(spark: SparkSession, sf: str) -> DataFrame:
    """Files named after their type, or not, confirmed by their structure."""
    layers = _layers(spark, sf)
    scores = identity.score_layers(layers, *_specs(spark, sf))
    name = F.concat(F.lit("sicar_"), F.lower(F.regexp_replace("nome", "[^A-Za-z]+", "_")), F.lit("_"), F.col("layer").cast("string"), F.lit(".zip"))
    files = layers.select("layer", name.alias("arquivo"))
    patterns = table(spark, sf, "part").select(F.col("p_type").alias("dataset"), F.concat(F.lit("*"), "p_type", F.lit("*")).alias("padrao")).distinct()
    hits = identity.name_hits(files, patterns)
    eligible = scores.where("geometria_ok and obrigatorio_ok and estrutura >= 6").join(files, "layer")
    eligible = eligible.select("arquivo", "dataset", F.lit(False).alias("historico"), "estrutura", "mapeados")
    return identity.classify_files(hits, eligible, files)


@query(
    "D5 P3",
    sql="""with h as (select distinct l_orderkey as arquivo, p_name as campo from lineitem join part on l_partkey = p_partkey),
    spec as (select p_type as dataset, p_name as campo, min(p_size) <= 1 as req from part group by 1, 2),
    need as (select dataset, count(*) as total from spec where req group by 1),
    per as (select arquivo, dataset, count(*) filter (req) as r, count(*) as n from h join spec using (campo) group by 1, 2),
    ok as (select * from per join need using (dataset) where r = total),
    lead_ as (select *, rank() over (partition by arquivo order by r desc, n desc) as rk from ok),
    best as (select arquivo, count(*) as k, min(dataset) as dataset from lead_ where rk = 1 group by 1)
    select a.arquivo, case when k = 1 then dataset end as dataset, case when k = 1 then 'CLASSIFICADO' when k > 1 then 'AMBIGUO' else 'NAO_CLASSIFICADO' end as status
    from (select distinct arquivo from h) a left join best using (arquivo)""",
)
def header_classification(spark: SparkSession, sf: str) -> DataFrame:
    specs, _ = _specs(spark, sf)
    full = specs.withColumn("alias", F.col("campo"))
    headers = _layers(spark, sf).select(F.col("layer").alias("arquivo"), "campos")
    return identity.classify_headers(headers, full)


@query(
    "D7 U5",
    sql="""with h as (select l_orderkey as layer, list(distinct l_linenumber) as f from lineitem group by 1)
    select layer, array_to_string(list_sort(list_filter([1, 2, 3], lambda x: not list_contains(f, x) and not list_contains(f, x + 3))), ',') as grupos_ausentes,
      array_to_string(list_sort(list_filter(f, lambda x: x > 5)), ',') as extras, array_to_string(list_sort(list_filter([1, 2, 3, 4, 5], lambda x: not list_contains(f, x))), ',') as faltantes from h""",
)
def required_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Any-of groups of header names, extra and missing columns per order."""
    li = table(spark, sf, "lineitem")
    h = li.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("Campo "), F.col("l_linenumber").cast("string"))).alias("f"))
    name = lambda i: F.lit(f"CAMPO_{i}")
    groups = F.array(*[F.array(name(i), name(i + 3)) for i in (1, 2, 3)])
    known = F.array(*[name(i) for i in range(1, 6)])
    have = F.transform("f", identity.tx.normal_name)
    want = F.transform(known, identity.tx.normal_name)
    added, missing = drift.header_difference(want, have)
    digits = lambda c: F.array_join(F.array_sort(F.transform(c, lambda v: F.regexp_extract(v, "([0-9]+)", 1))), ",")
    absent = F.transform(identity.group_identity(F.col("f"), groups), lambda g: F.get(g, F.lit(0)))
    return h.select(
        F.col("l_orderkey").alias("layer"), digits(absent).alias("grupos_ausentes"), digits(added).alias("extras"), digits(missing).alias("faltantes")
    )


def _field_versions(spark: SparkSession, sf: str, layer: str = "l_suppkey") -> tuple[DataFrame, DataFrame]:
    """Field tables per supplier: shipped lines are the old version, open lines the new one."""
    li = table(spark, sf, "lineitem")
    kind = lambda tax: F.when(tax > 0.06, "real").when(tax > 0.04, "integer").otherwise("text")
    per = li.groupBy(layer, "l_linestatus", F.concat(F.lit("campo_"), F.col("l_linenumber").cast("string"), "l_returnflag").alias("nome")).agg(
        F.max("l_tax").alias("t"), F.min("l_discount").alias("d"), F.max("l_quantity").alias("q"), F.min("l_linenumber").alias("posicao")
    )
    both = per.select(
        F.col(layer).alias("layer"), "l_linestatus",
        F.when(F.col("q") > 45, F.upper("nome")).otherwise(F.col("nome")).alias("nome"),
        kind(F.col("t")).alias("tipo"), F.col("q").cast("int").alias("largura"), F.lit(0).alias("precisao"), "posicao",
        F.when(F.col("d") > 0, "a").otherwise("b").alias("descricao"),
    )
    return both.where("l_linestatus = 'F'").drop("l_linestatus"), both.where("l_linestatus = 'O'").drop("l_linestatus")


_VERSIONS = """f as (select l_suppkey as layer, l_linestatus as v, 'campo_' || l_linenumber::varchar || l_returnflag as nome0, max(l_tax) as t, min(l_discount) as d, max(l_quantity) as q from lineitem group by 1, 2, 3),
v as (select layer, v, lower(nome0) as k, case when q > 45 then upper(nome0) else nome0 end as nome, case when t > 0.06 then 'real' when t > 0.04 then 'integer' else 'text' end as tipo, q::int as largura, case when d > 0 then 'a' else 'b' end as descricao from f),
a as (select * from v where v = 'F'), b as (select * from v where v = 'O')"""


@query(
    "D8 F21",
    sql=f"""with {_VERSIONS}, c as (select a.layer, a.nome as na, b.nome as nb, a.tipo as ta, b.tipo as tb, a.largura as la, b.largura as lb from a join b on a.layer = b.layer and a.k = b.k)
    select layer, 'FIELD_SPELLING_CHANGED' as tipo, na as de, nb as para, 'INFO' as severidade from c where na <> nb
    union all select layer, 'FIELD_TYPE_CHANGED', na, nb, 'WARNING' from c where ta <> tb
    union all select layer, 'NUMERIC_PRECISION_CHANGED', na, nb, 'WARNING' from c where ta = tb and la <> lb and ta in ('integer', 'real')""",
)
def field_changes_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling, type and precision of the fields both versions have."""
    return drift.in_place_changes(*_field_versions(spark, sf))


# Names are campo_, one digit and one letter, so eight characters: the matching blocks of two hold
# the six common ones and what else is equal.
# Layers are parts: their versions lack some of the names, suppliers have them all.
_PARTS = _VERSIONS.replace("l_suppkey", "l_partkey").replace("a as (", "w as (select *, substr(k, 7, 1)::int as p from v), a as (").replace("from v where", "from w where")
_CHANGES = f"""recursive {_PARTS},
al as (select distinct l_linenumber as campo, lower('campo_' || l_linenumber || l_returnflag) as k from lineitem where l_linenumber <= 2),
ra as (select layer, campo, min(k) as ka, min_by(nome, k) as na from a join al using (k) group by 1, 2),
rb as (select layer, campo, min(k) as kb, min_by(nome, k) as nb from b join al using (k) group by 1, 2),
ren as (select * from ra join rb using (layer, campo) where ka <> kb),
g as (select * from a where (layer, k) not in (select layer, k from b) and (layer, k) not in (select layer, ka from ren)),
c as (select * from b where (layer, k) not in (select layer, k from a) and (layer, k) not in (select layer, kb from ren) and layer in (select layer from a)),
pair as (select g.layer, g.k as ka, c.k as kb, (12 + 2 * (g.p = c.p)::int + 2 * (g.k[8] = c.k[8])::int) / 16.0::double * 0.75::double + case abs(g.p - c.p) when 0 then 0.25::double when 1 then 0.175::double else 0.0::double end as s
  from g join c on g.layer = c.layer and (g.tipo = c.tipo or (g.tipo <> 'text' and c.tipo <> 'text'))),
wish as (select layer, ka, list(kb order by s desc, kb) as l, row_number() over (partition by layer order by ka) as r from pair where s >= 0.62 group by layer, ka),
pick as (select distinct layer, 0::bigint as r, null::varchar as ka, null::varchar as kb, []::varchar[] as used from wish
  union all select w2.layer, w2.r, w2.ka, list_filter(w2.l, lambda x: not list_contains(pick.used, x))[1],
    list_concat(pick.used, list_filter(w2.l, lambda x: not list_contains(pick.used, x))[1:1]) from pick join wish w2 on w2.layer = pick.layer and w2.r = pick.r + 1),
likely as (select pick.layer, pick.ka, pick.kb, s from pick join pair using (layer, ka, kb)),
com as (select a.layer, a.nome as na, b.nome as nb, a.tipo as ta, b.tipo as tb, a.largura as la, b.largura as lb from a join b on a.layer = b.layer and a.k = b.k)"""


@query(
    "D8",
    sql=f"""with {_CHANGES}
    select layer, 'FIELD_SPELLING_CHANGED' as tipo, na as de, nb as para, 'INFO' as severidade, null::varchar as confianca from com where na <> nb
    union all select layer, 'FIELD_TYPE_CHANGED', na, nb, 'WARNING', null from com where ta <> tb
    union all select layer, 'NUMERIC_PRECISION_CHANGED', na, nb, 'WARNING', null from com where ta = tb and la <> lb and ta in ('integer', 'real')
    union all select layer, 'FIELD_RENAMED', na, nb, 'WARNING', 'HIGH' from ren
    union all select l.layer, 'POSSIBLE_FIELD_RENAMED', g.nome, c.nome, 'WARNING', case when s >= 0.75 then 'MEDIUM' else 'LOW' end from likely l join g on g.layer = l.layer and g.k = l.ka join c on c.layer = l.layer and c.k = l.kb
    union all select layer, 'FIELD_REMOVED', nome, null, 'WARNING', null from g where (layer, k) not in (select layer, ka from likely)
    union all select layer, 'FIELD_ADDED', null, nome, 'INFO', null from c where (layer, k) not in (select layer, kb from likely)""",
)
def field_changes(spark: SparkSession, sf: str) -> DataFrame:
    """All changes of fields between two versions, renames by alias and likely renames included."""
    name = F.concat(F.lit("campo_"), F.col("l_linenumber").cast("string"), "l_returnflag")
    lines = table(spark, sf, "lineitem").where("l_linenumber <= 2")
    aliases = lines.select(F.col("l_linenumber").alias("campo"), name.alias("nome")).distinct()
    return drift.field_changes(*_field_versions(spark, sf, "l_partkey"), aliases)


@query("D8")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Severity and text of all changes per layer, renames included."""
    return drift.drift_summary(drift.field_changes(*_field_versions(spark, sf)))


_LAYERS = """l as (select s_suppkey as layer, 'camada_' || s_nationkey as a_nome, case when s_suppkey % 3 = 0 then 'camada_' || s_name else 'camada_' || s_nationkey end as b_nome,
  'arq_' || s_nationkey as a_arquivo, case when s_acctbal < 0 then null else 'arq_' || s_nationkey end as b_arquivo,
  case s_suppkey % 4 when 0 then 'Polygon' when 1 then 'MultiPolygon' when 2 then 'Point' else '' end as a_geo,
  case s_suppkey % 5 when 0 then 'Polygon' when 1 then 'MULTIPOLYGON' when 2 then 'LineString' when 3 then 'Polygon' end as b_geo,
  case when s_suppkey % 6 > 0 then 4674 end as a_epsg, case when s_suppkey % 7 > 1 then 4674 when s_suppkey % 7 = 1 then 4326 end as b_epsg,
  'SIRGAS' as a_crs, case when s_acctbal > 5000 then 'WGS' else 'SIRGAS' end as b_crs from supplier)"""


def _layer_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf, "supplier")
    k, nation = F.col("s_suppkey"), F.concat(F.lit("camada_"), F.col("s_nationkey").cast("string"))
    file = F.concat(F.lit("arq_"), F.col("s_nationkey").cast("string"))
    kind = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    old = s.select(
        k.alias("layer"), nation.alias("nome_camada"), file.alias("arquivo"),
        kind(4, ["Polygon", "MultiPolygon", "Point", ""]).alias("geometria"),
        F.when(k % 6 > 0, 4674).alias("epsg"), F.lit("SIRGAS").alias("crs"),
    )
    new = s.select(
        k.alias("layer"),
        F.when(k % 3 == 0, F.concat(F.lit("camada_"), "s_name")).otherwise(nation).alias("nome_camada"),
        F.when(F.col("s_acctbal") >= 0, file).alias("arquivo"),
        kind(5, ["Polygon", "MULTIPOLYGON", "LineString", "Polygon", None]).alias("geometria"),
        F.when(k % 7 > 1, 4674).when(k % 7 == 1, 4326).alias("epsg"),
        F.when(F.col("s_acctbal") > 5000, "WGS").otherwise("SIRGAS").alias("crs"),
    )
    return old, new


_FAMILY = "case when contains(lower({0}), 'polygon') then 'polygon' else lower({0}) end"


@query(
    "D8",
    sql=f"""with {_LAYERS}
    select layer, 'LAYER_RENAMED' as tipo, a_nome as de, b_nome as para, 'WARNING' as severidade from l where a_nome <> b_nome
    union all select layer, 'DATASET_FILE_RENAMED', a_arquivo, b_arquivo, 'INFO' from l where a_arquivo is distinct from b_arquivo
    union all select layer, 'GEOMETRY_TYPE_CHANGED', a_geo, b_geo, case when {_FAMILY.format("a_geo")} = {_FAMILY.format("b_geo")} then 'WARNING' else 'CRITICAL' end
      from l where a_geo <> '' and b_geo is not null and lower(a_geo) <> lower(b_geo)
    union all select layer, 'CRS_CHANGED', a_epsg::varchar, b_epsg::varchar, 'WARNING' from l where a_epsg <> b_epsg
    union all select layer, 'CRS_CHANGED', a_crs, b_crs, 'WARNING' from l where a_epsg is null and a_crs <> b_crs""",
)
def layer_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Name, file, geometry type and reference system of a layer between two versions."""
    return drift.layer_changes(*_layer_versions(spark, sf))


@query(
    "J22 D9 J21",
    sql="""with d as (select p_partkey as layer, case p_partkey % 3 when 0 then [4674] when 1 then [4326, 4674] else [] end as a, case p_partkey % 4 when 0 then [4674] when 1 then [4326, 4674] else [] end as b,
        ['UTF-8'] as ca, case when p_size > 25 then ['latin1'] else ['UTF-8'] end as cb, case when p_size > 10 then 4674 else 31982 end as epsg from part)
      select layer, 'DICTIONARY_SRID_CHANGED' as tipo, a::varchar as de, b::varchar as para, 'INFO' as severidade from d where a <> b
      union all select layer, 'DICTIONARY_CHARSET_CHANGED', ca::varchar, cb::varchar, 'INFO' from d where ca <> cb
      union all select layer, 'DICTIONARY_CRS_DIVERGENCE', epsg::varchar, b::varchar, 'WARNING' from d where len(b) > 0 and not list_contains(b, epsg)""",
)
def dictionary_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Reference systems and character sets of a dictionary, and its conflict with the layer."""
    p = table(spark, sf, "part")
    k, epsg = F.col("p_partkey"), F.when(F.col("p_size") > 10, 4674).otherwise(31982).alias("epsg")
    none = F.array().cast("array<int>")
    srids = lambda n: F.when(k % n == 0, F.array(F.lit(4674))).when(k % n == 1, F.array(F.lit(4326), F.lit(4674))).otherwise(none)
    old = p.select(k.alias("layer"), srids(3).alias("srids"), F.array(F.lit("UTF-8")).alias("charsets"), epsg)
    changed = F.when(F.col("p_size") > 25, F.array(F.lit("latin1"))).otherwise(F.array(F.lit("UTF-8")))
    return drift.dictionary_notes(old, p.select(k.alias("layer"), srids(4).alias("srids"), changed.alias("charsets"), epsg))


@query(
    "D9 J21",
    sql=f"""with {_VERSIONS}
    select coalesce(a.layer, b.layer) as layer, coalesce(a.k, b.k) as campo, case when a.k is null then 'AUSENTE_NA_CAMADA' when b.k is null then 'NAO_DOCUMENTADO' else 'TIPO_DIVERGENTE' end as problema
    from a full join b on a.layer = b.layer and a.k = b.k where a.k is null or b.k is null or (a.tipo <> b.tipo and not (a.tipo in ('integer', 'real') and b.tipo in ('integer', 'real')))""",
)
def dictionary_differences(spark: SparkSession, sf: str) -> DataFrame:
    return drift.dictionary_differences(*_field_versions(spark, sf))


@query(
    "J22",
    sql=f"""with {_VERSIONS}
    select coalesce(a.layer, b.layer) as layer, coalesce(a.k, b.k) as campo, case when b.k is null then 'DICTIONARY_FIELD_REMOVED' when a.k is null then 'DICTIONARY_FIELD_ADDED' when a.tipo <> b.tipo then 'DICTIONARY_TYPE_CHANGED' else 'DICTIONARY_DESCRIPTION_CHANGED' end as mudanca
    from a full join b on a.layer = b.layer and a.k = b.k where a.k is null or b.k is null or a.tipo <> b.tipo or a.descricao <> b.descricao""",
)
def metadata_changes(spark: SparkSession, sf: str) -> DataFrame:
    return drift.metadata_changes(*_field_versions(spark, sf))


@query(
    "P1 P10 G8",
    sql=f"""with {roles.MESSY_SQL}
    select o_orderkey::varchar as codigo, case when regexp_full_match(replace(trim(raw_price), ',', '.'), '[-+]?[0-9]+([.][0-9]+)?') then replace(trim(raw_price), ',', '.')::decimal(38,10)::double end as area_ha,
      null::varchar as fase, 'PRODES' as fonte, 'exemplo' as dataset_slug, 'CERRADO' as bioma from messy""",
)
def canonical_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases matched, values typed, absent fields NULL, fixed values added."""
    dataset = Dataset(
        "exemplo",
        parse_fields("codigo:text! ← o_orderk; area_ha:numeric ← area, RAW_PRICE; fase:text; criacao:date_flexible ← raw_date"),
        fixed={"bioma": "CERRADO"},
    )
    raw = roles.messy_orders(spark, sf).withColumnRenamed("o_orderkey", "o_orderkey_original")
    renamed = raw.withColumnRenamed("o_orderkey_original", "CODIGO")
    out = conform.canonical(renamed, dataset, "PRODES", geometry=None)
    return out.select("codigo", F.col("area_ha").cast("double").alias("area_ha"), "fase", "fonte", "dataset_slug", "bioma")


@query(
    "P21 O7",
    sql="""select o_orderkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O' and contains(o_orderkey::varchar, '7') order by o_orderdate desc, o_orderkey limit 300""",
)
def recent_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered list of the newest batches; the limit is the list's own size."""
    from ..operators import status

    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")
    hits = status.search(o.withColumn("texto", F.col("o_orderkey").cast("string")), "7", ["texto"])
    return hits.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(300).select("o_orderkey")


@query(
    "P25",
    sql="""select c_custkey, case when c_acctbal < 0 then 'INACTIVE' when c_mktsegment = 'BUILDING' then 'YEARLY' else 'MONTHLY' end as ciclo from customer""",
)
def backfilled_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-based backfill of a column that older rows lack."""
    c = table(spark, sf, "customer")
    rule = F.when(F.col("c_acctbal") < 0, "INACTIVE").when(F.col("c_mktsegment") == "BUILDING", "YEARLY")
    return c.select("c_custkey", rule.otherwise("MONTHLY").alias("ciclo"))


@query(
    "F20 F21 G8",
    sql="""select n_nationkey, case n_nationkey % 4 when 0 then 'polygon' when 1 then 'line' when 2 then 'point' else 'raster' end as familia,
      case n_nationkey % 4 when 0 then 'real' when 1 then 'integer' when 2 then 'text' else 'datetime' end as tipo from nation""",
)
def declared_families(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import geometry as geo

    n = table(spark, sf, "nation")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), F.col("n_nationkey") % 4)
    return n.select(
        "n_nationkey",
        geo.family(pick("MultiPolygon Z", "MultiCurve", "Point", "Raster")).alias("familia"),
        drift.type_family(pick("Double(10,2)", "Integer64", "String", "Timestamp")).alias("tipo"),
    )
