"""The registered queries in plain SQL (DuckDB dialect), written independently of the library."""

from __future__ import annotations

_STAGES = ("Stage I", "Stage II", "Stage III", "Stage IV")
_BAND = """case when age >= 0 and age < 40 then 'age_0_40' when age >= 40 and age < 50 then 'age_40_50'
 when age >= 50 and age < 60 then 'age_50_60' when age >= 60 and age < 70 then 'age_60_70'
 when age >= 70 and age < 80 then 'age_70_80' when age >= 80 and age < 100 then 'age_80_100' end"""

RAW = f"""
o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as day, substr(o_orderpriority, 3) as prio,
   lead(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt,
   max(cast(o_orderdate as date)) over () as cutoff from orders),
raw as (select o_orderkey as row_id, o_custkey as case_id, case when nxt is not null then 1 else 0 end as ev,
   date_diff('day', day, coalesce(nxt, cutoff)) as raw_days, prio,
   case prio when 'URGENT' then 'Stage IA' when 'HIGH' then 'Stage IIB' when 'MEDIUM' then 'Stage III'
     when 'LOW' then 'Stage IVC' else '''--' end as substage,
   case prio when 'URGENT' then 'Stage I' when 'HIGH' then 'Stage II' when 'MEDIUM' then 'Stage III'
     when 'LOW' then 'Stage IV' end as stage,
   n_name as site, c_acctbal / 100 as age
   from o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
timed as (select *, cast(case when raw_days <= 0 then 1 else raw_days end as double) as days, {_BAND} as band from raw)"""

COHORT = RAW + """,
cohort as (select row_id, case_id, ev as event_occurred, days / 365.25 as observed_time, age as age_at_index,
   stage as ajcc_pathologic_stage, site as tissue_or_organ_of_origin, band as age_group
   from timed where stage is not null and site in
   ('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4','NATION_5','NATION_6')),
scored as (select *, round(0.03 * (age_at_index - 60) + case ajcc_pathologic_stage when 'Stage II' then 0.5
   when 'Stage III' then 1.0 when 'Stage IV' then 1.8 else 0.0 end, 8) as risk from cohort)"""

_NINE = "('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4','NATION_5','NATION_6','NATION_7','NATION_8')"


def raw(select: str) -> str:
    return f"with {RAW}\n{select}"


def of_cohort(select: str, ctes: str = "") -> str:
    return f"with {COHORT}{',' + ctes if ctes else ''}\n{select}"


def hashed(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def km(source: str, by: str = "", keep: str = "", band: bool = True, ctes: str = "", last: str = "") -> str:
    """Kaplan-Meier over ``source`` with optional grouping column, size filter and final select."""
    b = f"{by}," if by else ""
    part = f"partition by {by}" if by else ""
    band_cols = ""
    if band:
        band_cols = """, round(case when s = 1 then 1.0 when s > 0 then exp(-exp(ln(-ln(s)) - 1.959963984540054 * sqrt(g) / ln(s))) end, 6) as ci_lower,
        round(case when s = 1 then 1.0 when s > 0 then exp(-exp(ln(-ln(s)) + 1.959963984540054 * sqrt(g) / ln(s))) end, 6) as ci_upper"""
    body = f"""
    lt as (select {b} observed_time as t, cast(sum(event_occurred) as bigint) as d, count(*) as m from {source} group by all),
    ar as (select *, cast(sum(m) over ({part} order by t desc) as bigint) as n, cast(sum(m) over ({part}) as bigint) as size,
        min(t) over ({part}) as t0 from lt),
    cv as (select *, product(1 - d / n) over ({part} order by t) as s,
        coalesce(sum(case when n > d then d / (n * 1.0 * (n - d)) end) over ({part} order by t), 0) as g from ar {keep}),
    pts as (select {b} t, n, d, m - d as c, s, g from cv
        union all select distinct {b} 0.0, size, 0, 0, 1.0, 0.0 from cv where t0 > 0),
    curve as (select {b} round(t, 6) as t, n as n_at_risk, d as events, c as censored, round(s, 6) as survival{band_cols} from pts)"""
    return of_cohort(last or "select * from curve", f"{ctes + ',' if ctes else ''}{body}")


_TERCILES = """
q as (select quantile_cont(risk, 1/3.0) as a, quantile_cont(risk, 2/3.0) as b from scored),
grouped as (select scored.*, case when risk <= a then 'baixo' when risk <= b then 'médio' else 'alto' end as risk_group from scored, q)"""

_SPLIT = f"""
ranked as (select *, row_number() over (partition by event_occurred order by {hashed("'42'", 'row_id')}, row_id) as rk,
   count(*) over (partition by event_occurred) as n_all from cohort),
split as (select *, case when rk <= round(n_all * 0.2) then 'test' else 'train' end as split from ranked)"""

_FOLD = f"cast({hashed(chr(39) + '42' + chr(39), 'row_id')} % 5 as int)"


def histogram(by: str, column: str, source: str = "cohort") -> str:
    b = f"{by}," if by else ""
    on = f"using ({by})" if by else "on true"
    return of_cohort(
        f"select {b} bin, round(lo + w * bin, 6) as bin_lo, round(lo + w * (bin + 1), 6) as bin_hi, "
        f"coalesce(n, 0)::bigint as n from filled",
        f"""
    mm as (select {b} min({column}) as lo, max({column}) as hi, (max({column}) - min({column})) / 30 as w from {source} group by all),
    c as (select {b} least(floor(({column} - lo) / w), 29)::int as bin, count(*) as n from {source} join mm {on} group by all),
    grid as (select mm.*, unnest(range(30))::int as bin from mm),
    filled as (select grid.*, c.n from grid left join c using ({b} bin))""",
    )


def cindex(source: str, by: str = "", last: str = "") -> str:
    b = f"{by}," if by else ""
    on = f"a.{by} = b.{by} and" if by else ""
    ab = f"a.{by}," if by else ""
    body = f"""
    pairs as (select {ab} count(*)::double as comparable, sum(case when a.risk > b.risk then 1 else 0 end)::double as concordant,
       sum(case when a.risk = b.risk then 1 else 0 end)::double as tied_risk
       from {source} a join {source} b on {on} a.event_occurred = 1 and
       (a.observed_time < b.observed_time or (a.observed_time = b.observed_time and b.event_occurred = 0)) group by all),
    ci as (select *, (concordant + tied_risk / 2) / comparable as c_index from pairs)"""
    return body, (last or f"select {b} comparable, concordant, tied_risk, round(c_index, 6) as c_index from ci")


def _cindex_fixed() -> str:
    body, last = cindex("scored")
    return of_cohort(last, body)


_FOLDED = f"folded as (select *, {_FOLD} as fold from scored)"


def _cindex_folds(last: str = "") -> str:
    body, select = cindex("folded", "fold", last)
    return of_cohort(select, f"{_FOLDED}, {body}")


def _onehot(keep: str = "row_id, split") -> str:
    cols = [f"(case when ajcc_pathologic_stage = '{s}' then 1.0 else 0.0 end)::double as \"ajcc_pathologic_stage_{s}\"" for s in _STAGES[1:]]
    cols += [f"(case when tissue_or_organ_of_origin = 'NATION_{i}' then 1.0 else 0.0 end)::double as \"tissue_or_organ_of_origin_NATION_{i}\"" for i in range(1, 7)]
    return of_cohort(f"select {keep}, round(age_at_index, 6) as age_at_index, {', '.join(cols)} from split", _SPLIT)


def _kde() -> str:
    return of_cohort(
        "select point, round(x, 6) as x, round(density, 6) as density from k",
        """
    mm as (select min(age_at_index) as lo, max(age_at_index) as hi, count(*) as total,
       stddev_samp(age_at_index) * pow(count(*), -0.2) as bw from cohort),
    fine as (select least(floor((age_at_index - lo) / ((hi - lo) / 4096)), 4095)::int as bin, count(*) as n,
       sum(age_at_index) / count(*) as c from cohort, mm group by 1),
    grid as (select unnest(range(200))::int as point),
    k as (select point, lo + (hi - lo) * point / 199 as x,
       sum(n * exp(-pow((lo + (hi - lo) * point / 199 - c) / bw, 2) / 2)) / (total * bw * 2.5066282746310002) as density
       from fine, grid, mm group by point, lo, hi, total, bw)""",
    )


def _audit() -> str:
    return raw(f"""select * from (
    with f as (select *, site in {_NINE} as a, site in {_NINE} and stage is not null as st,
        site in {_NINE} and stage is not null and site not in ('NATION_7','NATION_8') as kept from timed),
    c as (select count(*) as n, count(*) filter (a) as n_site, count(*) filter (a and raw_days <= 0) as clamped,
        count(*) filter (a and band is null) as noband, count(*) filter (st) as n_st, count(*) filter (kept) as n_kept from f)
    select 1::int as step_order, 'site filter' as step, n as rows_in, n_site as rows_out, n - n_site as affected from c
    union all select 2, 'missing time', n_site, n_site, 0 from c
    union all select 3, 'time clamp', n_site, n_site, clamped from c
    union all select 4, 'age outside bands', n_site, n_site, noband from c
    union all select 5, 'unmapped stage', n_site, n_st, n_site - n_st from c
    union all select 6, 'sparse sites', n_st, n_kept, n_st - n_kept from c)""")


_FEATURES = """row_id, case_id, event_occurred, round(observed_time, 6) as observed_time,
 round(age_at_index, 6) as age_at_index, ajcc_pathologic_stage, tissue_or_organ_of_origin"""
_TEXTS = """row_id, case when ev = 1 then 'Dead' else 'Alive' end as vital_status,
 case when ev = 1 then '''--' else raw_days::varchar end as days_to_last_follow_up,
 case when ev = 1 then raw_days::varchar else '''--' end as days_to_death,
 age as age_at_index, substage as ajcc_pathologic_stage, site as tissue_or_organ_of_origin"""

_DUMMIES = [(f"ajcc_pathologic_stage_{s}", f"ajcc_pathologic_stage = '{s}'") for s in _STAGES[1:]] + [
    (f"tissue_or_organ_of_origin_NATION_{i}", f"tissue_or_organ_of_origin = 'NATION_{i}'") for i in range(1, 7)
]
_LONG = "long as (select row_id, event_occurred as e, observed_time as t, unnest(f) as f from (select *, [" + ", ".join(
    ["{'name': 'age_at_index', 'x': age_at_index}"]
    + [f"{{'name': '{n}', 'x': (case when {c} then 1.0 else 0.0 end)::double}}" for n, c in _DUMMIES]
) + "] as f from cohort))"


def _cox_gradient() -> str:
    return of_cohort(
        "select feature, round(sum(dx) - sum(expected), 6) as gradient from terms group by 1",
        f"""{_LONG},
    pt as (select f.name as feature, t, sum(e) as d, count(*) as m, sum(f.x) as sx, sum(f.x * e) as dx from long group by 1, 2),
    rs as (select *, sum(m) over w as n, sum(sx) over w as big from pt window w as (partition by feature order by t desc)),
    terms as (select feature, dx, coalesce((select sum((big - l * 1.0 / d * dx) / (n - l)) from unnest(range(d::bigint)) u(l)), 0) as expected from rs)""",
    )


_BRESLOW = """
    pt as (select observed_time as t, sum(event_occurred) as d, count(*) as m from cohort group by 1),
    rs as (select *, sum(m) over (order by t desc) as n from pt),
    ab as (select t, sum(d / n) over (order by t) as a, sum(d / (n * 1.0 * n)) over (order by t) as b from rs),
    gh as (select cohort.*, a, a - event_occurred as g, a - b as h from cohort join ab on t = observed_time)"""


def _root_gain() -> str:
    each = " union all ".join(
        f"""select '{name}' as feature, sum(case when {cond} then g else 0 end) as gr, sum(case when {cond} then h else 0 end) as hr,
        sum(g) as gt, sum(h) as ht from gh""" for name, cond in _DUMMIES
    )
    return of_cohort(
        """select feature, round(gr * gr / (hr + 0.1) + (gt - gr) * (gt - gr) / (ht - hr + 0.1) - gt * gt / (ht + 0.1), 6) as gain
        from (select * from sums) where hr > 0""",
        f"{_BRESLOW}, sums as ({each})",
    )


def _age_grid(points: int) -> str:
    def edge(p: float, name: str) -> str:
        return f"(select least(greatest(n * {p} + 0.4 + 0.2 * {p} - 1, 0), n - 1) as pos from cnt) {name}"

    return f"""
    cnt as (select count(*) as n from cohort),
    sorted as (select age_at_index as v, row_number() over (order by age_at_index) - 1 as k from cohort),
    ends as (select p, max(case when k = floor(pos) then v end) as a, max(case when k = least(floor(pos) + 1, n - 1) then v end) as b,
        max(pos - floor(pos)) as f from sorted, cnt, (select 0 as p, pos from {edge(0.05, 'x')} union all select 1, pos from {edge(0.95, 'y')}) group by p),
    lim as (select max(case when p = 0 then a + (b - a) * f end) as lo, max(case when p = 1 then a + (b - a) * f end) as hi from ends),
    few as (select count(distinct age_at_index) < {points} as few from cohort),
    grid as (select lo + (hi - lo) * i / {points - 1} as v from lim, few, unnest(range({points})) u(i) where not few
        union all select distinct age_at_index from cohort, few where few)"""


_WEIGHT = "case ajcc_pathologic_stage when 'Stage II' then 0.5 when 'Stage III' then 1.0 when 'Stage IV' then 1.8 else 0.0 end"


def _permutation() -> str:
    body = f"""
    reps as (select cohort.*, r::int as repeat from cohort, unnest(range(10)) u(r)),
    don as (select repeat, age_at_index as age_d, ajcc_pathologic_stage as stage_d,
        row_number() over (partition by repeat order by {hashed("'42'", "repeat", "'donor'", "row_id")}, row_id) as k from reps),
    tak as (select *, row_number() over (partition by repeat order by {hashed("'42'", "repeat", "'taker'", "row_id")}, row_id) as k from reps),
    both_ as (select * from tak join don using (repeat, k)),
    wide as (select 'age_at_index' as feature, repeat, event_occurred, observed_time, round(0.03 * (age_d - 60) + {_WEIGHT}, 8) as risk from both_
      union all select 'ajcc_pathologic_stage', repeat, event_occurred, observed_time,
        round(0.03 * (age_at_index - 60) + {_WEIGHT.replace('ajcc_pathologic_stage', 'stage_d')}, 8) from both_
      union all select 'real', 0, event_occurred, observed_time, round(0.03 * (age_at_index - 60) + {_WEIGHT}, 8) from cohort),
    ci as (select a.feature, a.repeat, sum(case when a.risk > b.risk then 1.0 when a.risk = b.risk then 0.5 else 0 end) / count(*) as c
       from wide a join wide b on a.feature = b.feature and a.repeat = b.repeat and a.event_occurred = 1 and
       (a.observed_time < b.observed_time or (a.observed_time = b.observed_time and b.event_occurred = 0)) group by all)"""
    return of_cohort(
        """select feature, round(avg(r.c - ci.c), 6) as importance_mean, round(stddev_pop(r.c - ci.c), 6) as importance_std
        from ci, (select c from ci where feature = 'real') r where feature <> 'real' group by 1""",
        body,
    )


ORACLE = {
    "ingest_tsv_roundtrip": raw(f"select {_TEXTS} from raw"),
    "csv_roundtrip": of_cohort(f"select {_FEATURES}, age_group from cohort"),
    "select_rename": raw(f"select {_TEXTS} from raw"),
    "site_filter": raw(f"select row_id, site as tissue_or_organ_of_origin from raw where site in {_NINE}"),
    "sparse_site_filter": raw("select row_id, site as tissue_or_organ_of_origin from raw where site not in ('NATION_7','NATION_8')"),
    "numeric_coerce": raw("""select row_id, case when ev = 0 then raw_days::double end as days_to_last_follow_up,
        case when ev = 1 then raw_days::double end as days_to_death, age as age_at_index from raw"""),
    "event_flag": raw("select row_id, ev as event_occurred from raw"),
    "observed_time": raw("select row_id, ev as event_occurred, days as observed_days, round(days / 365.25, 6) as observed_time from timed"),
    "age_bands": raw("select row_id, band as age_group from timed"),
    "stage_group": raw("select row_id, stage as ajcc_pathologic_stage from raw where stage is not null"),
    "display_columns": of_cohort("""select row_id, case_id, event_occurred, round(observed_time, 6) as observed_time,
        round(age_at_index, 6) as idade, ajcc_pathologic_stage as estagio_patologico_ajcc,
        tissue_or_organ_of_origin as tecido_ou_orgao_de_origem from cohort"""),
    "recode_labels": of_cohort("""select row_id,
        case when site_no < 5 then 'Local ' || site_no end as localizacao,
        replace(substr(age_group, 5), '_', '-') as faixa,
        case event_occurred when 1 then 'Falecido' when 0 then 'Vivo' end as vital_status
        from (select *, substr(tissue_or_organ_of_origin, 8)::int as site_no from cohort)"""),
    "value_replace": raw("select row_id, case when stage is null then 'Não Reportado' else substage end as ajcc_pathologic_stage from raw"),
    "clean_feature_names": of_cohort("""select distinct feature, replace(replace(label, '_', ' '), 'Stage I', 'Estágio I') as label from (
        select 'ajcc_pathologic_stage_' || ajcc_pathologic_stage as feature, ajcc_pathologic_stage as label from cohort
        union all select 'tissue_or_organ_of_origin_' || tissue_or_organ_of_origin, tissue_or_organ_of_origin from cohort
        union all select 'age_group_' || age_group, age_group from cohort where age_group is not null
        union all select 'age_at_index', 'age_at_index' from cohort)"""),
    "step_audit": _audit(),
    "features_without_time": of_cohort(f"select {_FEATURES}, age_group from cohort where age_at_index >= 0 or age_at_index is null"),
    "audit_without_time": raw(f"""select * from (
    with f as (select *, age is null or age >= 0 as timed from timed where site in {_NINE}),
    t as (select * from f where timed),
    c as (select (select count(*) from timed) as n, (select count(*) from f) as n_site, count(*) as n_timed,
        count(*) filter (raw_days <= 0) as clamped, count(*) filter (band is null) as noband, count(stage) as n_st,
        count(stage) filter (site not in ('NATION_7','NATION_8')) as n_kept from t)
    select 1::int as step_order, 'site filter' as step, n as rows_in, n_site as rows_out, n - n_site as affected from c
    union all select 2, 'missing time', n_site, n_timed, n_site - n_timed from c
    union all select 3, 'time clamp', n_timed, n_timed, clamped from c
    union all select 4, 'age outside bands', n_timed, n_timed, noband from c
    union all select 5, 'unmapped stage', n_timed, n_st, n_timed - n_st from c
    union all select 6, 'sparse sites', n_st, n_kept, n_st - n_kept from c)"""),
    "inner_join_fanout": raw("""select row_id, l_linenumber as sample_number, l_returnflag as sample_type
        from raw join lineitem on l_orderkey = row_id"""),
    "feature_table": of_cohort("""select row_id, event_occurred, round(observed_time, 6) as observed_time,
        round(age_at_index, 6) as age_at_index, ajcc_pathologic_stage, tissue_or_organ_of_origin
        from cohort join lineitem on l_orderkey = row_id"""),
    "preview_top10": of_cohort("""select event_occurred as "Evento (Óbito)", round(observed_time, 6) as "Tempo (Anos)",
        round(age_at_index, 6) as "Idade", age_group as "Faixa Etária", ajcc_pathologic_stage as "Estágio",
        tissue_or_organ_of_origin as "Localização" from cohort order by row_id limit 10"""),
    "count_by_stage": raw("select case when stage is null then 'Não Reportado' else substage end as ajcc_pathologic_stage, count(*) as n from raw group by 1"),
    "count_by_site": of_cohort("""select 'Local ' || substr(tissue_or_organ_of_origin, 8) as localizacao, count(*) as n
        from cohort where substr(tissue_or_organ_of_origin, 8)::int < 5 group by 1"""),
    "counts_sorted_by_stage": of_cohort("select ajcc_pathologic_stage, count(*) as n from cohort group by 1"),
    "distinct_stages": of_cohort("select distinct ajcc_pathologic_stage from cohort"),
    "mortality_by_age_band": of_cohort("""select case age_group when 'age_0_40' then 0 when 'age_40_50' then 1 when 'age_50_60' then 2
        when 'age_60_70' then 3 when 'age_70_80' then 4 else 5 end as band_order,
        replace(substr(age_group, 5), '_', '-') as band, count(*) as total, sum(event_occurred)::bigint as deaths,
        round(sum(event_occurred) * 100.0 / count(*), 6) as death_rate_pct
        from cohort where age_group is not null group by age_group"""),
    "status_share": of_cohort("""select k::int as event_occurred, label as status, count(event_occurred) as n,
        round(count(event_occurred) * 100.0 / (select count(*) from cohort), 6) as pct
        from (values (0, 'Vivo / Censurado'), (1, 'Falecido')) v(k, label) left join cohort on k = event_occurred group by 1, 2"""),
    "histogram_age": histogram("", "age_at_index"),
    "histogram_time_by_event": histogram("event_occurred", "observed_time"),
    "kde_age": _kde(),
    "median_time_by_event": of_cohort("select event_occurred, round(median(observed_time), 6) as median from cohort group by 1"),
    "km_global": km("cohort"),
    "km_by_stage": km("cohort", "ajcc_pathologic_stage", "where size > 10"),
    "km_by_risk_group": km("grouped", "risk_group", ctes=_TERCILES),
    "km_median": km("cohort", "ajcc_pathologic_stage", last="""select ajcc_pathologic_stage,
        round(coalesce(min(case when s <= 0.5 then t end), max(t)), 6) as median_time from pts group by 1"""),
    "km_event_gap": km("gaps", band=False, ctes="""
    inst as (select distinct user_id, epoch_us(ts) as tick from events),
    nx as (select *, lead(tick) over (partition by user_id order by tick) as nxt, max(tick) over () as fin from inst),
    gaps as (select user_id, (coalesce(nxt, fin) - tick) / 1e6 as observed_time, case when nxt is null then 0 else 1 end as event_occurred from nx)"""),
    "nelson_aalen": of_cohort("""select round(t, 6) as t, n as n_at_risk, d as events,
        round(sum(d / n) over (order by t), 6) as cumulative_hazard from (
        select *, cast(sum(m) over (order by t desc) as bigint) as n from (
        select observed_time as t, cast(sum(event_occurred) as bigint) as d, count(*) as m from cohort group by 1))"""),
    "risk_terciles": of_cohort("select row_id, risk_group from grouped", _TERCILES),
    "onehot_encode": _onehot(),
    "split_snapshot": _onehot("row_id, event_occurred, round(observed_time, 6) as observed_time, split"),
    "model_roundtrip": of_cohort(
        "select model_name, 0.0::double as difference, (select count(*) from cohort) as n_rows "
        "from (values ('CoxPH'), ('RandomSurvivalForest'), ('XGBoostSurvival')) m(model_name)"
    ),
    "align_columns": of_cohort("""select row_id, round(age_at_index, 6) as age_at_index,
        (case when ajcc_pathologic_stage = 'Stage IV' then 1 else 0 end)::double as "ajcc_pathologic_stage_Stage IV",
        0::double as "ajcc_pathologic_stage_Stage V",
        (case when tissue_or_organ_of_origin = 'NATION_2' then 1 else 0 end)::double as "tissue_or_organ_of_origin_NATION_2" from cohort"""),
    "signed_label": of_cohort("select row_id, round(case when event_occurred = 1 then observed_time else -observed_time end, 6) as signed_time from cohort"),
    "stratified_holdout": of_cohort("select row_id, split from split", _SPLIT),
    "kfold_assign": of_cohort(f"select row_id, {_FOLD} as fold from cohort"),
    "subset_fraction": of_cohort(f"""select row_id from (select row_id, row_number() over (order by {hashed("'42'", 'row_id')}, row_id) as rk,
        count(*) over () as n from cohort) where rk <= floor(n * 0.3)"""),
    "permute_labels": of_cohort("select r.row_id, d.event_occurred, round(d.observed_time, 6) as observed_time from r join d using (k)", f"""
    d as (select row_number() over (order by {hashed("'0:donor'", 'row_id')}, row_id) as k, event_occurred, observed_time from cohort),
    r as (select row_number() over (order by {hashed("'0:taker'", 'row_id')}, row_id) as k, row_id from cohort)"""),
    "cindex_fixed_score": _cindex_fixed(),
    "cindex_by_fold": _cindex_folds(),
    "fold_score_summary": _cindex_folds("""select 'fixed' as model_name, round(avg(c_index), 6) as mean_c_index,
        round(stddev_pop(c_index), 6) as std_c_index from ci where c_index > 0"""),
    "cox_score_at_zero": _cox_gradient(),
    "boosted_grad_round1": of_cohort("select row_id, round(g, 6) as gradient, round(h, 6) as curvature from gh", _BRESLOW),
    "boosted_root_gain": _root_gain(),
    "logrank_score": of_cohort("select row_id, round(event_occurred - a, 6) as score from gh", _BRESLOW),
    "pdp_linear": of_cohort(f"""select 'age_at_index' as feature, round(v, 6) as value,
        round(avg(round(0.03 * (v - 60) + {_WEIGHT}, 8)), 6) as mean_prediction from grid, cohort group by v""", _age_grid(100)),
    "ice_linear": of_cohort(f"""select row_id, 'age_at_index' as feature, round(v, 6) as value,
        round(0.03 * (v - 60) + {_WEIGHT}, 6) as prediction
        from (select * from cohort order by {hashed("'42'", "row_id")}, row_id limit 100), grid""", _age_grid(100)),
    "permutation_importance_linear": _permutation(),
}
