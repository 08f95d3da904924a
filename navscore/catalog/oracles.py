"""SQL that computes the same results in DuckDB.

Values are whole ten-thousandths and metrics whole thousandths here, so rounding half up
is integer arithmetic: ``(2 * a + b) // (2 * b)``.
"""

from __future__ import annotations

from navscore.catalog.queries import SCOPES
from navscore.catalog.tables import TABLE_ABS_EDGES
from navscore.operators.bands import band_labels
from navscore.operators.measures import REL_EDGES
from navscore.plans.reports import COMMON_LABELS, REPORTS
from navscore.schemas import ALL_VENDORS, GROUPINGS, VENDORS

QUOTES = """
raw as (
  select l_partkey as part_key, cast(l_shipdate as date) as day,
    cast(floor(l_extendedprice * 100.0::double + 0.5::double) as bigint) as cents,
    cast(floor(l_quantity + 0.5::double) as bigint) as qty,
    cast(floor(l_discount * 100.0::double + 0.5::double) as bigint) as disc,
    cast(floor(l_tax * 100.0::double + 0.5::double) as bigint) as tax
  from lineitem),
valued as (
  select part_key, day, disc, tax, (200 * cents + qty) // (2 * qty) as nav from raw),
quotes as (
  select *, (nav * (12957 + 10 * tax)) // 13000 as ant,
    (nav * (17047 - 10 * disc)) // 17000 as tiantian,
    (nav * (2300 + tax - disc)) // 2300 as jy,
    (nav + 5000) // 10000 * 10000 as hm,
    disc - 5 as report_r, tax - 4 as ant_r, 6 - disc as tiantian_r, tax - disc as jy_r,
    disc - tax as hm_r
  from valued)"""

TABLE_SUMMARY = (
    QUOTES
    + """,
summary as (
  select quotes.*, part_key as fund_code, p_type as type,
    cast(floor(p_retailprice * 10000.0::double + 0.5::double) as bigint) as wind
  from quotes join part on part_key = p_partkey {top})"""
)

JOINED_SUMMARY = (
    QUOTES
    + """,
hm_feed as (select part_key, day, min(hm) as hm, min(hm_r) as hm_r from quotes group by all),
ant_feed as (
  select part_key, day, max(ant) as ant, max(ant_r) as ant_r from quotes group by all
  having max(ant_r) > -4),
wind_feed as (select part_key, day, min(nav) as wind from quotes group by all),
summary as (
  select cast(q.part_key as varchar) as fund_code, p_type as type, q.day, q.nav, q.report_r,
    ant_feed.ant, ant_feed.ant_r, hm_feed.hm, hm_feed.hm_r, q.jy, q.jy_r, q.tiantian,
    q.tiantian_r, wind_feed.wind, p_size
  from quotes q
  join hm_feed on q.part_key = hm_feed.part_key and q.day = hm_feed.day
  join ant_feed on q.part_key = ant_feed.part_key and q.day = ant_feed.day
  join wind_feed on q.part_key = wind_feed.part_key and q.day = wind_feed.day
  join part on q.part_key = p_partkey)"""
)

# Feeds with gaps, joined from the left: nulls where a vendor lacks a fund-day.
SPARSE_SUMMARY = (
    JOINED_SUMMARY.replace("  join hm_feed", "  left join hm_feed")
    .replace("  join ant_feed", "  left join ant_feed")
    .replace("  join wind_feed", "  left join wind_feed")
    .replace("min(hm_r) as hm_r from quotes group by all", "min(hm_r) as hm_r from quotes "
             "group by all having min(hm_r) > -2")
    .replace("min(nav) as wind from quotes group by all", "min(nav) as wind from quotes "
             "where part_key % 3 <> 0 group by all")
)

ORDER = ("ant", "hm", "jy", "tiantian", "wind")


def _summary_select(vendors=ALL_VENDORS) -> str:
    columns = ["fund_code", "type", "day", "nav / 10000.0::double as report_nav"]
    columns.append("report_r / 100.0::double as report_return")
    for code in ORDER:
        if code in vendors:
            columns.append(f"{code} / 10000.0::double as {code}_nav")
            if VENDORS[code].has_return:
                columns.append(f"{code}_r / 100.0::double as {code}_return")
    return ", ".join(columns)


def _long(vendors) -> str:
    """One row per row and vendor: deviation, ratio, rounded deviations, direction."""
    parts = []
    for code in vendors:
        opposite = f"report_r * {code}_r < 0" if VENDORS[code].has_return else "null"
        parts.append(
            f"select type, day, '{code}' as vendor, nav, abs({code} - nav) as dev, "
            f"{opposite} as opposite from summary"
        )
    return (
        ", quoted as ("
        + " union all ".join(parts)
        + """), long as (
  select *, cast(dev * 10000 as double) / cast(nav * 10000 as double) as ratio,
    dev * 100 as abs_round,
    cast(floor(cast(dev * 10000 as double) * 100000.0::double / cast(nav * 10000 as double)
      + 0.5::double) as bigint) as rel_round
  from quoted)"""
    )


def _half_up(numerator: str, denominator: str) -> str:
    return f"((2 * ({numerator}) + ({denominator})) // (2 * ({denominator})))"


def _share(count: str) -> str:
    return _half_up(f"100000 * ({count})", "count(*)")


def _median(value: str) -> str:
    half = f"list_sort(list({value}))"
    return f"(({half}[(count(*) + 1) // 2] + {half}[count(*) // 2 + 1] + 1) // 2)"


def _std(value: str) -> str:
    """Population deviation of whole numbers rounded half up, decided on whole numbers."""
    n = "count(*)::hugeint"
    v = f"({n} * sum({value}::hugeint * {value}) - sum({value}::hugeint) * sum({value}))"
    k = f"cast(floor(sqrt(({v})::double) / count(*) + 0.5::double) as hugeint)"
    return (
        f"(case when 4 * {v} >= (2 * {k} + 1) * (2 * {k} + 1) * {n} * {n} then {k} + 1 "
        f"when {k} > 0 and 4 * {v} < (2 * {k} - 1) * (2 * {k} - 1) * {n} * {n} then {k} - 1 "
        f"else {k} end)"
    )


def _ratio_total() -> str:
    """Ratios summed with twelve decimals."""
    return (
        "sum(cast(floor(ratio) as hugeint) * 1000000000000 "
        "+ cast(floor((ratio - floor(ratio)) * 1e12::double + 0.5::double) as hugeint))"
    )


# Report -> metric columns, in thousandths (the count of R1 is a plain count).
METRICS = {
    "r1_opposite": {
        "opposite": "count(*) filter (where opposite)",
        "opposite_pct": _share("count(*) filter (where opposite)"),
    },
    "r2_abs_mean": {"abs_mean": _half_up("100 * sum(dev)", "count(*)")},
    "r3_abs_median": {"abs_median": _median("abs_round")},
    "r4_abs_std": {"abs_std": _std("abs_round")},
    "r5_rel_mean": {"rel_mean": _half_up(_ratio_total(), "count(*) * 10000000")},
    "r6_rel_median": {"rel_median": _median("rel_round")},
    "r7_rel_std": {"rel_std": _std("rel_round")},
}


# The edges written out, in the units of this SQL (ten-thousandths and ratios), and the names
# that the edges give the columns.
ABS_LIMITS = ("10000", "30000", "50000", "100000", "200000")
ABS_BANDS = ("le_1", "gt_1_le_3", "gt_3_le_5", "gt_5_le_10", "gt_10_le_20", "gt_20")
ABS_UP_TO = ("le_1", "le_3", "le_5", "le_10", "le_20", "gt_20")
REL_LIMITS = ("0.0005", "0.001", "0.003", "0.005", "0.01")
REL_BANDS = (
    "le_0p0005", "gt_0p0005_le_0p001", "gt_0p001_le_0p003", "gt_0p003_le_0p005",
    "gt_0p005_le_0p01", "gt_0p01",
)
REL_UP_TO = ("le_0p0005", "le_0p001", "le_0p003", "le_0p005", "le_0p01", "gt_0p01")


def _bands(name: str) -> dict[str, str]:
    cumulative = name in ("r9_abs_cumulative", "r11_rel_cumulative")
    if name in ("r8_abs_bands", "r9_abs_cumulative"):
        value, limits = "dev", ABS_LIMITS
        columns = ABS_UP_TO if cumulative else ABS_BANDS
    else:
        value, limits = "ratio", [f"{limit}::double" for limit in REL_LIMITS]
        columns = REL_UP_TO if cumulative else REL_BANDS
    conditions = []
    for i, limit in enumerate(limits):
        low = f"{value} > {limits[i - 1]} and " if i and not cumulative else ""
        conditions.append(f"{low}{value} <= {limit}")
    conditions.append(f"{value} > {limits[-1]}")
    return {
        column: _share(f"count(*) filter (where {condition})")
        for column, condition in zip(columns, conditions, strict=True)
    }


def _as_number(thousandths: str) -> str:
    return f"cast({thousandths} as bigint) / 1000.0::double"


def _as_percent_text(thousandths: str) -> str:
    value = f"cast({thousandths} as bigint)"
    return f"({value} // 1000) || '.' || lpad(cast({value} % 1000 as varchar), 3, '0') || '%'"


def coverage_sql(name: str, scope_name: str) -> str:
    """A report over the vendors' own rows, with the number of these rows."""
    keys = GROUPINGS[SCOPES[scope_name][0]]
    key_list = "".join(f"{k}, " for k in keys)
    by = f" group by {', '.join(keys)}" if keys else ""
    same = " and ".join(["true", *[f"g.{k} = s.{k}" for k in keys]])
    if REPORTS[name].cumulative is not None:
        values = _bands(name)
    else:
        values = METRICS[name]
    inner = ", ".join(f"{v} as {c}" for c, v in values.items())
    listed = ", ".join(f"('{code}')" for code in ALL_VENDORS)
    head = (
        f"with {SPARSE_SUMMARY}{_long(ALL_VENDORS)}, present as (select * from long where dev is "
        f"not null), scored as (select {key_list}vendor, count(*) as n, {inner} from present "
        f"group by {key_list}vendor), groups as (select {key_list}count(*) as fund_count "
        f"from summary{by})"
    )
    if REPORTS[name].cumulative is not None:
        shares = ", ".join(f"{_as_number(c)} as {c}" for c in values)
        return (
            f"{head} select {''.join(f'g.{k}, ' for k in keys)}v.vendor, coalesce(n, 0) as rows, "
            f"{shares} from groups g cross join (values {listed}) v(vendor) "
            f"left join scored s on {same} and s.vendor = v.vendor"
        )
    columns = []
    for code in ALL_VENDORS:
        if REPORTS[name].part != "medians":
            rows = f"coalesce(max(case when vendor = '{code}' then n end), 0)"
            columns.append(f"{rows} as {code}_rows")
        if name == "r1_opposite" and not VENDORS[code].has_return:
            continue
        for metric in values:
            value = f"max(case when vendor = '{code}' then {metric} end)"
            if metric == "opposite":
                value = f"coalesce({value}, 0)"
            else:
                value = _as_number(value)
            columns.append(f"{value} as {code}_{metric}")
    grouped = ", ".join(f"g.{k}" for k in (*keys, "fund_count"))
    return (
        f"{head} select {grouped}, {', '.join(columns)} from groups g left join scored s on {same} "
        f"group by {grouped}"
    )


def groupings_sql(name: str, summary: str) -> str:
    """A report of all levels by grouping sets."""
    sets = "grouping sets ((type, day, vendor), (type, vendor), (vendor))"
    level = "case when grouping(day) = 0 then 'day' when grouping(type) = 0 then 'week' else 'all' end"
    head = f"with {summary}{_long(ALL_VENDORS)}"
    if REPORTS[name].cumulative is not None:
        shares = ", ".join(f"{_as_number(v)} as {c}" for c, v in _bands(name).items())
        return f"{head} select {level} as level, type, day, vendor, {shares} from long group by {sets}"
    inner = ", ".join(f"{v} as {c}" for c, v in METRICS[name].items())
    return (
        f"{head}, scored as (select {level} as level, type, day, vendor, count(*) as n, {inner} "
        f"from long group by {sets}) select level, type, day, max(n) as fund_count, "
        f"{_wide_columns(name, ALL_VENDORS)} from scored group by level, type, day"
    )


def _wide_columns(name: str, vendors, text: bool = False) -> str:
    """The metrics of each vendor side by side, from one row per group and vendor."""
    spec = REPORTS[name]
    columns = []
    for code in vendors:
        if name == "r1_opposite" and not VENDORS[code].has_return:
            continue
        for metric in METRICS[name]:
            value = f"max(case when vendor = '{code}' then {metric} end)"
            label = f"{code}_{metric}"
            is_percent = metric.endswith("_pct") or spec.percent
            if metric != "opposite":
                value = _as_percent_text(value) if text and is_percent else _as_number(value)
            if text:
                label = VENDORS[code].label + dict(spec.suffixes)[metric]
            columns.append(f'{value} as "{label}"')
    return ", ".join(columns)


def report_sql(name: str, scope_name: str, summary: str | None = None, text: bool = False) -> str:
    """A report over the summary CTE; ``text`` gives the display form."""
    grouping, vendors, top = SCOPES[scope_name]
    keys = GROUPINGS[grouping]
    spec = REPORTS[name]
    if summary is None:
        summary = TABLE_SUMMARY.format(top="where p_size <= 5" if top else "")
    head = f"with {summary}{_long(vendors)}"
    key_list = "".join(f"{k}, " for k in keys)
    key_columns = "".join(f'{k} as "{COMMON_LABELS[k]}", ' if text else f"{k}, " for k in keys)
    by = f" group by {', '.join(keys)}" if keys else ""

    if spec.cumulative is not None:
        bands = _bands(name)
        if not text:
            shares = ", ".join(f"{_as_number(v)} as {c}" for c, v in bands.items())
            return f"{head} select {key_list}vendor, {shares} from long group by {key_list}vendor"
        edges = TABLE_ABS_EDGES if spec.kind == "abs" else REL_EDGES
        labels = band_labels(edges, spec.cumulative, spec.kind == "rel")
        cases = " ".join(f"when '{c}' then '{VENDORS[c].label}'" for c in vendors)
        shares = ", ".join(
            f'{_as_percent_text(v)} as "{label}"' for v, label in zip(bands.values(), labels)
        )
        return (
            f'{head} select {key_columns}case vendor {cases} end as "{COMMON_LABELS["vendor"]}", '
            f"{shares} from long group by {key_list}vendor"
        )

    inner = ", ".join(f"{v} as {c}" for c, v in METRICS[name].items())
    count_label = COMMON_LABELS["fund_count"] if text else "fund_count"
    return (
        f"{head}, scored as (select {key_list}vendor, count(*) as n, {inner} from long "
        f"group by {key_list}vendor) select {key_columns}max(n) as \"{count_label}\", "
        f"{_wide_columns(name, vendors, text)} from scored{by}"
    )


# --- feeds ------------------------------------------------------------------------------

CODE = "right('000000' || cast(part_key as varchar), 6)"

FEED_SQL = {
    "truth": f"""select {CODE} as fund_code, 'F' as fund_type, day,
        jy / 10000.0::double as jy_nav, jy_r / 100.0::double as jy_return,
        nav / 10000.0::double as report_nav, report_r / 100.0::double as report_return,
        '0' as jy_sign_error, '0.1' as jy_deviation,
        tiantian / 10000.0::double as tiantian_nav,
        tiantian_r / 100.0::double as tiantian_return,
        '0' as tiantian_sign_error, '0.2' as tiantian_deviation
      from quotes where tax <> 0 and disc not in (0, 5)""",
    "hm": f"""select {CODE} as fund_code, day, '15:00' as quote_time,
        hm / 10000.0::double as hm_nav, hm_r / 100.0::double as hm_return
      from quotes where tax <> 0""",
    "ant": f"""select {CODE} as fund_code, 'fund' as fund_name,
        strftime(day, '%Y-%m-%d') as trading_day,
        cast(report_r / 100.0::double as varchar) as total_return, day,
        strftime(day, '%Y-%m-%d') as estimate_date, ant / 10000.0::double as ant_nav,
        '"' || case when ant_r >= 0 then '+' else '' end
          || cast(ant_r / 100.0::double as varchar) || '%"' as ant_ratio
      from quotes where tax <> 0""",
    "wind": f"""select {CODE} as fund_code, nav / 10000.0::double as wind_nav, day
      from quotes where tax <> 0""",
}
FEED_SQL["hm_pipe"] = FEED_SQL["hm"]

PART_FEED_SQL = {
    "fund_classes": """select right('000000' || cast(p_partkey as varchar), 6) as fund_code,
        substr(p_type, 1, 2) as class_code from part""",
    "class_names": "select substr(p_type, 1, 2) as class_code, p_type as type from part",
    "top_list": """select '2021-03-04' as list_date, p_type as asset_class,
        p_brand as merchant_code, right('000000' || cast(p_partkey as varchar), 6) as fund_code,
        p_name as fund_name, cast(p_size as varchar) as users_held,
        cast(p_retailprice as varchar) as amount from part""",
}

REJECTS_SQL = f"""with {QUOTES}, reasons as (
  select 'truth' as feed, case when tax = 0 then 'field_count' when disc = 5 then 'empty_field'
    when disc = 0 then 'unreadable_jy_return' end as reject_reason from quotes
  union all select 'hm', case when tax = 0 then 'field_count' end from quotes
  union all select 'hm_pipe', case when tax = 0 then 'unreadable_day' end from quotes
  union all select 'ant', case when tax = 0 then 'no_estimate' end from quotes
  union all select 'wind', case when tax = 0 then 'no_estimate' end from quotes)
select feed, reject_reason, count(*) as lines from reasons
where reject_reason is not null group by all"""


def oracle_sql() -> dict[str, str]:
    table = TABLE_SUMMARY.format(top="")
    everything = _summary_select()
    joined = f"with {JOINED_SUMMARY} select {everything} from summary"
    last = "(select max(cast(l_shipdate as date)) from lineitem)"
    found = {
        "summary_table": f"with {table} select {everything} from summary",
        "summary_join": joined,
        "summary_nowind": f"with {JOINED_SUMMARY} select "
        + _summary_select([v for v in ALL_VENDORS if v != "wind"])
        + " from summary",
        "summary_top": f"{joined} where p_size <= 5",
        "summary_top_fanout": f"{joined} where p_size <= 5 union all "
        f"select {everything} from summary where p_size <= 2",
        "summary_latest_day": f"{joined} where day = {last}",
        "summary_latest_week": f"{joined} where day > {last} - 7",
        "dimension_join": "select s_suppkey as fund_code, r_name || '/' || n_name as type "
        "from supplier join nation on s_nationkey = n_nationkey "
        "join region on n_regionkey = r_regionkey",
        "feed_summary_text": f"with {table} select {everything} from summary".replace(
            "select fund_code,", "select cast(fund_code as varchar) as fund_code,"
        ),
        "feed_rejects": REJECTS_SQL,
        "store_summary_by_day": f"with {table} select {everything} from summary",
    }
    for name, sql in FEED_SQL.items():
        found[f"feed_{name}"] = f"with {QUOTES} {sql}"
    for name, sql in PART_FEED_SQL.items():
        found[f"feed_{name}"] = sql
    for scope_name in SCOPES:
        for name in REPORTS:
            found[f"{name}_{scope_name}"] = report_sql(name, scope_name)
    for name in ("r1_opposite", "r2_abs_mean", "r6_rel_median", "r8_abs_bands"):
        found[f"{name}_joined_week"] = report_sql(name, "week", JOINED_SUMMARY)
    for name in ("r1_opposite", "r5_rel_mean", "r9_abs_cumulative", "r10_rel_bands"):
        found[f"display_{name}_week"] = report_sql(name, "week", text=True)
    found["display_r8_abs_bands_day"] = report_sql("r8_abs_bands", "day", text=True)
    latest_week = TABLE_SUMMARY.format(top=f"where day > {last} - 7")
    for name in ("r2_abs_mean", "r3_abs_median", "r11_rel_cumulative"):
        found[f"stored_week_{name}"] = report_sql(name, "week", latest_week)
        found[f"scores_week_{name}"] = report_sql(name, "week")
    mixed = TABLE_SUMMARY.format(top=f"where day > {last} - 7 and day <= {last} - 3")
    for name in ("r2_abs_mean", "r9_abs_cumulative"):
        found[f"stored_mixed_vendors_{name[:2]}"] = report_sql(name, "week", mixed)
    for scope_name in ("week", "all"):
        for name in REPORTS:
            found[f"text_{scope_name}_{name.split('_')[0]}"] = report_sql(name, scope_name)
    for name in REPORTS:
        short = name.split("_")[0]
        found[f"coverage_{short}_week"] = coverage_sql(name, "week")
        found[f"groupings_{short}"] = groupings_sql(name, latest_week)
        kind = "histograms" if REPORTS[name].part == "medians" else "partials"
        found[f"{kind}_week_{short}"] = report_sql(name, "week", latest_week)
    for name in ("r2_abs_mean", "r3_abs_median", "r9_abs_cumulative"):
        short = name.split("_")[0]
        for scope_name in ("day", "all"):
            found[f"coverage_{short}_{scope_name}"] = coverage_sql(name, scope_name)
        found[f"coverage_full_{short}"] = report_sql(name, "week")
    held = " + ".join(
        f"case when {code} is null then 0 else {1 << i} end" for i, code in enumerate(ALL_VENDORS)
    )
    found["coverage_masks"] = (
        f"with {SPARSE_SUMMARY} select type, cast({held} as bigint) as present, "
        "count(*) as fund_days from summary group by all"
    )
    for name in ("r2_abs_mean", "r4_abs_std", "r5_rel_mean", "r10_rel_bands"):
        found[f"partials_all_{name.split('_')[0]}"] = report_sql(name, "all")
    for name in ("r3_abs_median", "r6_rel_median"):
        found[f"histograms_all_{name.split('_')[0]}"] = report_sql(name, "all")
    for kind in ("abs", "rel"):
        found[f"sketch_errors_{kind}"] = (
            f"with {table}{_long(ALL_VENDORS)} select type, vendor, count(*) as rows, "
            "true as within from long group by type, vendor"
        )
    for name in REPORTS:
        found[f"sql_{name.split('_')[0]}"] = report_sql(name, "week")
    found["sql_range"] = f"with {latest_week} select {everything} from summary"
    found["committed_week"] = f"with {latest_week} select {everything} from summary"
    for name in ("truth", "ant", "summary_text"):
        found[f"ingested_{name}"] = found[f"feed_{name}"]
    found["ingested_rejects"] = REJECTS_SQL
    found["csv_report_week"] = (
        "select columns(*)::varchar from (" + report_sql("r5_rel_mean", "week", text=True) + ")"
    )
    found["preview_smallest_groups"] = (
        report_sql("r2_abs_mean", "day") + " order by fund_count, type, day limit 20"
    )
    return found
