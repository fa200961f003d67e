"""SQL twins of the models fitted on few features: unrolled Newton steps, a stump of either kind."""

from __future__ import annotations

from .oracle import _BRESLOW, _DUMMIES, _FOLD, _SPLIT, _TERCILES, ORACLE as TABLES, hashed, km, of_cohort

_AGE = "age_at_index"
_PENALTY = 0.1


def _newton(steps: int = 7) -> str:
    """CTEs from tr (fit, e, t, x) to ``model`` (fit, b, info, n, sd, mean): Efron ties, ridge."""
    out = ["b0 as (select fit, 0.0::double as b, 0.0::double as info, count(*) as n, stddev_samp(x) as sd, avg(x) as mean from tr group by fit)"]
    for k in range(1, steps + 1):
        out.append(f"""
    s{k} as (select fit, t, sum(w) as s0, sum(w * x) as s1, sum(w * x * x) as s2, sum(e * w) as d0, sum(e * w * x) as d1,
        sum(e * w * x * x) as d2, sum(e)::bigint as d, sum(e * x) as dx
        from (select tr.*, exp(b * (x - mean)) as w from tr join b{k - 1} using (fit)) group by fit, t),
    r{k} as (select *, sum(s0) over w as big0, sum(s1) over w as big1, sum(s2) over w as big2 from s{k} window w as (partition by fit order by t desc)),
    u{k} as (select fit, sum(dx * 1.0 / d - a1 / a0) as u, sum(a2 / a0 - (a1 / a0) * (a1 / a0)) as i from (
        select fit, dx, d, big0 - l * 1.0 / d * d0 as a0, big1 - l * 1.0 / d * d1 as a1, big2 - l * 1.0 / d * d2 as a2
        from r{k}, unnest(range(d)) v(l)) group by fit),
    b{k} as (select fit, b + (u - {_PENALTY} * n * sd * sd * b) / (i + {_PENALTY} * n * sd * sd) as b, i + {_PENALTY} * n * sd * sd as info, n, sd, mean
        from b{k - 1} join u{k} using (fit))""")
    out.append(f"model as (select * from b{steps})")
    return ",".join(out)


def _pairs(source: str, by: str) -> str:
    """CTE ci (by, c): pairwise concordance of ``source`` (by, e, t, risk)."""
    keys = [k.strip() for k in by.split(",")]
    on = " and ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""ci as (select {', '.join(f'a.{k}' for k in keys)},
        sum(case when a.risk > b.risk then 1.0 when a.risk = b.risk then 0.5 else 0 end) / count(*) as c
        from {source} a join {source} b on {on} and a.e = 1 and (a.t < b.t or (a.t = b.t and b.e = 0)) group by all)"""


_ROWS = f"rows as (select row_id, split, event_occurred as e, observed_time as t, {_AGE} as x from split)"
_TRAIN = "tr as (select 0 as fit, * from rows where split = 'train')"
_RISK = "round(exp((x - mean) * b), 8) as risk"
_ONE = f"{_SPLIT}, {_ROWS}, {_TRAIN}, {_newton()}"


def _cox_table() -> str:
    return of_cohort(
        f"""select '{_AGE}' as feature, round(b, 6) as coef, round(exp(b), 6) as hazard_ratio, round(1 / sqrt(info), 6) as se,
        round(b - 1.959963984540054 / sqrt(info), 6) as coef_lower, round(b + 1.959963984540054 / sqrt(info), 6) as coef_upper,
        round(b * sqrt(info), 4) as z, round(mean, 6) as mean from model""", _ONE)


def _cox_risk() -> str:
    return of_cohort(f"select row_id, split, round(exp((x - mean) * b), 6) as risk from rows, model", _ONE)


def _cox_effect() -> str:
    return of_cohort(
        f"""select '{_AGE}' as feature, replace('{_AGE}', '_', ' ') as label, round(b, 6) as coef, round(exp(b), 6) as hazard_ratio,
        round(exp(b - 1.959963984540054 / sqrt(info)), 6) as hr_lower, round(exp(b + 1.959963984540054 / sqrt(info)), 6) as hr_upper,
        case when exp(b) > 1 then 'Fator de Risco (Piora)' else 'Fator Protetor (Melhora)' end as effect from model""", _ONE)


def _gap() -> str:
    return of_cohort(
        """select 'CoxPH' as model_name, round(a, 6) as c_index_train, round(b, 6) as c_index_test, round(a - b, 6) as gap,
        case when a - b > 0.05 then 'SIM' when a - b > 0.02 then 'LEVE' else 'NÃO' end as overfit
        from (select max(case when split = 'train' then c end) as a, max(case when split = 'test' then c end) as b from ci)""",
        f"{_ONE}, scored_ as (select split, e, t, {_RISK} from rows, model), {_pairs('scored_', 'split')}")


def _comparison() -> str:
    fits = f"""folded as (select *, {_FOLD} as fold from rows where split = 'train'),
    tr as (select k::int as fit, e, t, x from folded, unnest(range(5)) v(k) where fold <> k union all select 5, e, t, x from folded)"""
    scored = f"""scored_ as (select fit, e, t, {_RISK} from folded join model on fit = fold
        union all select 5, e, t, {_RISK} from rows join model on fit = 5 where split = 'test')"""
    return of_cohort(
        """select 'CoxPH' as model_name, round(avg(c) filter (where fit < 5), 6) as cv_mean_c_index,
        round(stddev_pop(c) filter (where fit < 5), 6) as cv_std_c_index, round(max(c) filter (where fit = 5), 6) as test_c_index from ci""",
        f"{_SPLIT}, {_ROWS}, {fits}, {_newton()}, {scored}, {_pairs('scored_', 'fit')}")


def _learning() -> str:
    fits = f"""ordered as (select *, row_number() over (order by {hashed("'42'", 'row_id')}, row_id) as place, count(*) over () as n_all from rows where split = 'train'),
    shares as (select k::int as fit, [0.1, 0.2, 0.3, 0.5, 0.7, 1.0][k + 1]::double as fraction from unnest(range(6)) v(k)),
    tr as (select fit, e, t, x from ordered, shares where place <= floor(n_all * fraction)),
    sizes as (select fit, fraction, floor(n_all * fraction)::bigint as n_rows from shares, (select max(n_all) as n_all from ordered) where floor(n_all * fraction) >= 50)"""
    scored = f"""scored_ as (select fit, 'train' as split, e, t, {_RISK} from tr join model using (fit)
        union all select fit, 'test', e, t, {_RISK} from rows, model where split = 'test')"""
    return of_cohort(
        """select 'CoxPH' as model_name, fraction, n_rows, round(max(case when split = 'train' then c end), 6) as c_index_train,
        round(max(case when split = 'test' then c end), 6) as c_index_test from ci join sizes using (fit) group by all""",
        f"{_SPLIT}, {_ROWS}, {fits}, {_newton()}, {scored}, {_pairs('scored_', 'fit, split')}")


def _shuffled() -> str:
    fits = f"""learn as (select * from rows where split = 'train'),
    don as (select s::int as s, e, t, row_number() over (partition by s order by {hashed("s || ':donor'", 'row_id')}, row_id) as k from learn, unnest(range(5)) v(s)),
    tak as (select s::int as s, x, row_number() over (partition by s order by {hashed("s || ':taker'", 'row_id')}, row_id) as k from learn, unnest(range(5)) v(s)),
    tr as (select 0 as fit, e, t, x from learn union all select s + 1, e, t, x from don join tak using (s, k))"""
    scored = f"scored_ as (select fit, e, t, {_RISK} from rows, model where split = 'test')"
    return of_cohort(
        """select 'CoxPH' as model_name, round(a, 6) as c_index_real, round(b, 6) as c_index_random_mean, round(a - b, 6) as difference
        from (select max(c) filter (where fit = 0) as a, avg(c) filter (where fit > 0) as b from ci)""",
        f"{_SPLIT}, {_ROWS}, {fits}, {_newton()}, {scored}, {_pairs('scored_', 'fit')}")


_SIDES = "sides as (select row_id, event_occurred as e, observed_time as t, unnest(f) as f from (select *, [" + ", ".join(
    f"{{'name': '{n}', 'x': ({c})::int, 'code': {2 * i + 1}}}" for i, (n, c) in enumerate(_DUMMIES)
) + "] as f from cohort))"


def _boosted(select: str) -> str:
    return of_cohort(select, f"""{_BRESLOW}, {_SIDES},
    sums as (select f.name as feature, sum(case when f.x = 1 then g else 0 end) as gr, sum(case when f.x = 1 then h else 0 end) as hr, sum(g) as gt, sum(h) as ht
        from sides join gh using (row_id) group by 1),
    best as (select *, gr * gr / (hr + 0.1) + (gt - gr) * (gt - gr) / (ht - hr + 0.1) - gt * gt / (ht + 0.1) as gain from sums where hr > 0 and hr < ht
        order by gain desc, feature limit 1)""")


_LOGRANK = f"""{_SIDES},
    times as (select distinct observed_time as t from cohort where event_occurred = 1),
    whole as (select times.t, count(*) filter (where observed_time >= times.t) as n, count(*) filter (where observed_time = times.t and event_occurred = 1) as d
        from times, cohort group by 1),
    part as (select f.name as feature, times.t, count(*) filter (where sides.t >= times.t) as nr, count(*) filter (where sides.t = times.t and e = 1) as dr
        from times, sides where f.x = 1 group by 1, 2),
    ranked_ as (select feature, pow(sum(dr - d * nr * 1.0 / n), 2) / sum(case when n > 1 then d * (nr * 1.0 / n) * (1 - nr * 1.0 / n) * (n - d) / (n - 1.0) else 0 end) as stat
        from part join whole using (t) where n > 1 group by 1),
    best as (select feature from ranked_ order by stat desc limit 1),
    placed as (select row_id, e, sides.t, f.x as side from sides join best on f.name = feature),
    leaf as (select side, times.t, count(*) filter (where placed.t >= times.t) as n, count(*) filter (where placed.t = times.t and e = 1) as d from times, placed group by 1, 2),
    steps as (select side, t, d * 1.0 / n as step, product(1 - d * 1.0 / n) over (partition by side order by t) as survival from leaf where d > 0),
    risks as (select side, sum(step * later) as risk from steps join (select t, count(*) over (order by t desc) as later from times) using (t) group by 1),
    medians as (select side, coalesce(min(t) filter (where survival <= 0.5 + 1e-9), (select max(observed_time) from cohort)) as median_ from steps group by 1)"""

_FEATURES = "feat as (select row_id, unnest(f) as f from (select row_id, [" + ", ".join(
    f"{{'name': '{n}', 'x': ({c})::int}}" for n, c in _DUMMIES
) + "] as f from cohort))"

_TWO = "rows as (select row_id, split, event_occurred as e, observed_time as t from split)"


def _stumps(allowed: str = "true") -> str:
    """CTEs from tr (fit, row_id, e, t) to ``side_risk`` (fit, side, risk): the best log-rank split of every fit, at least 15 rows a side."""
    return f"""{_FEATURES},
    times as (select fit, t, count(*) as m, sum(e) as d from tr group by 1, 2),
    whole as (select *, sum(m) over (partition by fit order by t desc) as n from times),
    pf as (select fit, f.name as feature, t, count(*) as m, sum(e) as d from tr join feat using (row_id) where f.x = 1 and {allowed} group by all),
    grid as (select w.fit, w.t, w.n, w.d, g.feature, coalesce(pf.m, 0) as mr, coalesce(pf.d, 0) as dr
        from whole w join (select distinct fit, feature from pf) g using (fit) left join pf using (fit, feature, t)),
    risked as (select *, sum(mr) over (partition by fit, feature order by t desc) as nr from grid),
    ranked_ as (select fit, feature, pow(sum(dr - d * nr * 1.0 / n), 2) / sum(case when n > 1 then d * (nr * 1.0 / n) * (1 - nr * 1.0 / n) * (n - d) / (n - 1.0) else 0 end) as stat
        from risked group by 1, 2 having max(nr) >= 15 and max(n) - max(nr) >= 15),
    best as (select fit, arg_max(feature, stat) as feature from ranked_ group by fit),
    placed as (select tr.*, f.x as side from tr join best using (fit) join feat on feat.row_id = tr.row_id and f.name = best.feature),
    leaf as (select fit, side, t, count(*) as m, sum(e) as d from placed group by all),
    steps as (select *, d * 1.0 / sum(m) over (partition by fit, side order by t desc) as step from leaf),
    later as (select fit, t, count(*) over (partition by fit order by t desc) as later from (select distinct fit, t from tr where e = 1)),
    side_risk as (select fit, side, round(sum(step * later), 8) as risk from steps join later using (fit, t) where d > 0 group by 1, 2)"""


def _scored(source: str, fit: str = "fit") -> str:
    """Rows of ``source`` with the risk that their fit gives them."""
    return f"""(select s.*, risk from (select *, {fit} as fit_ from {source}) s join best on best.fit = fit_
        join feat on feat.row_id = s.row_id and f.name = best.feature join side_risk r on r.fit = fit_ and r.side = f.x)"""


_FOREST = "'RandomSurvivalForest' as model_name"


def _comparison_stump() -> str:
    fits = f"""folded as (select *, {_FOLD} as fold from rows where split = 'train'),
    tr as (select k::int as fit, row_id, e, t from folded, unnest(range(5)) v(k) where fold <> k union all select 5, row_id, e, t from folded)"""
    scored = f"""scored_ as (select fold as fit, e, t, risk from {_scored('folded', 'fold')}
        union all select 5, e, t, risk from {_scored("(select * from rows where split = 'test')", '5')})"""
    return of_cohort(
        f"""select {_FOREST}, round(avg(c) filter (where fit < 5), 6) as cv_mean_c_index,
        round(stddev_pop(c) filter (where fit < 5), 6) as cv_std_c_index, round(max(c) filter (where fit = 5), 6) as test_c_index from ci""",
        f"{_SPLIT}, {_TWO}, {fits}, {_stumps()}, {scored}, {_pairs('scored_', 'fit')}")


_GAPS = """round(max(case when split = 'train' then c end), 6) as c_index_train, round(max(case when split = 'test' then c end), 6) as c_index_test,
        round(max(case when split = 'train' then c end) - max(case when split = 'test' then c end), 6) as gap"""


def _redundancy_stump() -> str:
    fits = "tr as (select k::int as fit, row_id, e, t from rows, unnest(range(2)) v(k) where split = 'train'), both_ as (select k::int as fit, rows.* from rows, unnest(range(2)) v(k))"
    stage = "ajcc_pathologic_stage"
    return of_cohort(
        f"select case when fit = 0 then 'Com {stage}' else 'Sem {stage}' end as configuration, {_FOREST}, {_GAPS} from ci group by fit",
        f"""{_SPLIT}, {_TWO}, {fits}, {_stumps(f"not (fit = 1 and f.name like '{stage}%')")},
        scored_ as (select fit, split, e, t, risk from {_scored('both_')}), {_pairs('scored_', 'fit, split')}""")


def _learning_stump() -> str:
    fits = f"""ordered as (select *, row_number() over (order by {hashed("'42'", 'row_id')}, row_id) as place, count(*) over () as n_all from rows where split = 'train'),
    shares as (select k::int as fit, [0.1, 0.2, 0.3, 0.5, 0.7, 1.0][k + 1]::double as fraction from unnest(range(6)) v(k)),
    sizes as (select fit, fraction, floor(n_all * fraction)::bigint as n_rows from shares, (select max(n_all) as n_all from ordered) where floor(n_all * fraction) >= 50),
    tr as (select fit, row_id, e, t from ordered join sizes on place <= n_rows),
    held as (select fit, rows.* from rows, sizes where split = 'test')"""
    scored = f"""scored_ as (select fit, 'train' as split, e, t, risk from {_scored('tr')} union all select fit, 'test', e, t, risk from {_scored('held')})"""
    return of_cohort(
        f"""select {_FOREST}, fraction, n_rows, round(max(case when split = 'train' then c end), 6) as c_index_train,
        round(max(case when split = 'test' then c end), 6) as c_index_test from ci join sizes using (fit) group by all""",
        f"{_SPLIT}, {_TWO}, {fits}, {_stumps()}, {scored}, {_pairs('scored_', 'fit, split')}")


def _shuffled_stump() -> str:
    fits = f"""learn as (select * from rows where split = 'train'),
    don as (select s::int as s, e, t, row_number() over (partition by s order by {hashed("s || ':donor'", 'row_id')}, row_id) as k from learn, unnest(range(5)) v(s)),
    tak as (select s::int as s, row_id, row_number() over (partition by s order by {hashed("s || ':taker'", 'row_id')}, row_id) as k from learn, unnest(range(5)) v(s)),
    tr as (select 0 as fit, row_id, e, t from learn union all select s + 1, row_id, e, t from don join tak using (s, k)),
    held as (select k::int as fit, rows.* from rows, unnest(range(6)) v(k) where split = 'test')"""
    return of_cohort(
        f"""select {_FOREST}, round(a, 6) as c_index_real, round(b, 6) as c_index_random_mean, round(a - b, 6) as difference
        from (select max(c) filter (where fit = 0) as a, avg(c) filter (where fit > 0) as b from ci)""",
        f"{_SPLIT}, {_TWO}, {fits}, {_stumps()}, scored_ as (select fit, e, t, risk from {_scored('held')}), {_pairs('scored_', 'fit')}")


def _complexity_stump() -> str:
    return of_cohort(
        f"select 1 as max_depth, {_GAPS} from ci",
        f"""{_SPLIT}, {_TWO}, {_FEATURES},
    pt as (select t, sum(e) as d, count(*) as m from rows where split = 'train' group by 1),
    rs as (select *, sum(m) over (order by t desc) as n from pt),
    ab as (select t, sum(d * 1.0 / n) over (order by t) as a, sum(d / (n * 1.0 * n)) over (order by t) as b from rs),
    gh as (select row_id, a - e as g, a - b as h from rows join ab using (t) where split = 'train'),
    sums as (select f.name as feature, sum(case when f.x = 1 then g else 0 end) as gr, sum(case when f.x = 1 then h else 0 end) as hr, sum(g) as gt, sum(h) as ht
        from feat join gh using (row_id) group by 1),
    best as (select * from sums where hr > 0 and hr < ht
        order by gr * gr / (hr + 0.1) + (gt - gr) * (gt - gr) / (ht - hr + 0.1) desc, feature limit 1),
    scored_ as (select split, e, t, round(exp(case when f.x = 1 then -0.05 * gr / (hr + 0.1) else -0.05 * (gt - gr) / (ht - hr + 0.1) end), 8) as risk
        from rows join feat using (row_id) join best on f.name = best.feature), {_pairs('scored_', 'split')}""")


def _best_age_curves() -> str:
    renamed = _TERCILES.replace("q as", "q_ as").replace("grouped as", "by_model as").replace("scored.", "modelled.")
    renamed = renamed.replace("from scored, q)", "from modelled, q_)").replace("from scored)", "from modelled)")
    scored = "modelled as (select cohort.*, exp((age_at_index - mean) * b) as risk from cohort, model)"
    return km("by_model", "risk_group", ctes=f"{_ONE}, {scored}, {renamed}")


def _predictions_stump() -> str:
    return of_cohort(
        """select row_id, ajcc_pathologic_stage, tissue_or_organ_of_origin, event_occurred = 1 as "OS", round(observed_time, 6) as "OS_time",
        round(median_, 6) as predicted_survival_time from cohort join placed using (row_id) join medians using (side)""", _LOGRANK)


def _report_stump() -> str:
    def part(name: str, entry: str, first: str, second: str, sql: str, where: str = "true") -> str:
        return f"select '{name}' as report, {entry}::varchar as entry, {first} as first, {second} as second from ({sql}) where {where}"

    train, test = "c_index_train", "c_index_test"
    return " union all ".join([
        part("gap", "model_name", train, test, _redundancy_stump(), "configuration like 'Com%'"),
        part("redundancy", "configuration", train, test, _redundancy_stump()),
        part("complexity", "max_depth", train, test, _complexity_stump()),
        part("learning_curves", "n_rows", train, test, _learning_stump()),
        part("permutation", "model_name", "c_index_real", "c_index_random_mean", _shuffled_stump()),
    ])


ORACLE: dict[str, str] = {
    "diag_report_stump": _report_stump(),
    "comparison_stump": _comparison_stump(),
    "diag_redundancy_stump": _redundancy_stump(),
    "diag_learning_stump": _learning_stump(),
    "diag_permutation_stump": _shuffled_stump(),
    "diag_complexity_stump": _complexity_stump(),
    "report_roundtrip_age": _comparison(),
    "top_features_root": TABLES["boosted_root_gain"].replace("select feature, round(", "select row_number() over (order by gain desc, feature)::int as position, feature from (select feature, round(", 1)
    + ") order by gain desc, feature limit 3",
    "km_by_best_model_age": _best_age_curves(),
    "prediction_roundtrip_stump": _predictions_stump(),
    "cox_age_table": _cox_table(),
    "cox_age_risk": _cox_risk(),
    "cox_age_effect": _cox_effect(),
    "diag_gap_age": _gap(),
    "comparison_age": _comparison(),
    "diag_learning_age": _learning(),
    "diag_permutation_age": _shuffled(),
    "boosted_stump_risk": _boosted("""select row_id, round(exp(case when f.x = 1 then -0.05 * gr / (hr + 0.1) else -0.05 * (gt - gr) / (ht - hr + 0.1) end), 6) as risk
        from sides join best on f.name = feature"""),
    "boosted_stump_importance": _boosted("select feature, 1.0::double as weight, round(gain, 6) as gain from best"),
    "forest_stump_risk": of_cohort("select row_id, round(risk, 6) as risk from placed join risks using (side)", _LOGRANK),
    "forest_stump_median": of_cohort("select row_id, round(median_, 6) as predicted_survival_time from placed join medians using (side)", _LOGRANK),
    "forest_stump_curves": of_cohort("""select curve_id, round(t, 6) as t, round(survival, 6) as survival
        from (select distinct curve_id, side from (select row_id, coalesce(string_agg(f.code::varchar, ',' order by f.code) filter (where f.x = 1), '') as curve_id from sides group by 1) join placed using (row_id))
        join steps using (side)""", _LOGRANK),
}
