"""DuckDB statements and the frames they read."""

from __future__ import annotations

import re

KINDS = (1, 2, 3, 4, 5)

# Fixed values of the test tables' set-up.
WINDOW = "week >= DATE '2000-01-03' AND week < DATE '2001-01-01'"
BEFORE_END = "week < DATE '2001-01-01'"
DRIFT = "0.0627::DOUBLE"


def each(template: str, separator: str = ", ") -> str:
    return separator.join(template.replace("#", str(kind)) for kind in KINDS)


def num(value: str) -> str:
    # Adding zero turns a negative zero into a plain one.
    return f"({value})::DOUBLE + 0.0"


def rnd(value: str, digits: int) -> str:
    return f"round({value}, {digits})::DOUBLE + 0.0"


def per(top: str, bottom: str) -> str:
    return f"(({top})::DOUBLE / nullif(({bottom})::DOUBLE, 0))"


def pct(top: str, bottom: str) -> str:
    return f"(100.0::DOUBLE * ({top})::DOUBLE / nullif(({bottom})::DOUBLE, 0))"


def big(value: str) -> str:
    return f"({value})::BIGINT"


def rank(value: str, within: str = "") -> str:
    partition = f"PARTITION BY {within} " if within else ""
    return f"rank() OVER ({partition}ORDER BY {value} DESC NULLS LAST)"


LABEL = "'Markdown Type ' || kind"

# Name -> body. A body may read the frames before it.
FRAMES = {
    "lines": """
        SELECT c.c_nationkey AS store, p.p_type AS dept,
               date_trunc('week', o.o_orderdate)::DATE AS week,
               left(o.o_orderpriority, 1)::INTEGER AS kind,
               (l.l_extendedprice * CASE WHEN l.l_returnflag = 'R' AND l.l_quantity > 40 THEN -1 ELSE 1 END)
                   ::DECIMAL(18,2) AS net,
               net * l.l_discount::DECIMAL(4,2) AS discount
        FROM lineitem l, orders o, customer c, part p
        WHERE o.o_orderkey = l.l_orderkey AND c.c_custkey = o.o_custkey AND p.p_partkey = l.l_partkey""",
    "calendar": """
        SELECT DISTINCT week,
               CASE WHEN strftime(week, '%m%d') BETWEEN '0628' AND '0704' THEN 1
                    WHEN strftime(week, '%m%d') BETWEEN '1219' AND '1225' THEN 1
                    WHEN weekofyear(week) IN (6, 47) THEN 1 ELSE 0 END AS h
        FROM lines""",
    "sales": """
        SELECT store, dept, week, any_value(h) AS h, sum(net)::DECIMAL(18,2) AS amount
        FROM lines JOIN calendar USING (week) GROUP BY store, dept, week""",
    "recorded": f"""
        SELECT store, week, {each("round(sum(discount) FILTER (kind = #), 2)::DECIMAL(18,2) AS m#")}
        FROM lines WHERE week >= DATE '2000-01-03' GROUP BY store, week""",
    "spending": f"""
        SELECT g.store, g.week, g.h, {each("r.m#")}
        FROM (SELECT n_nationkey AS store, week, h FROM nation, calendar) g
        LEFT JOIN recorded r ON r.store = g.store AND r.week = g.week""",
    "shops": """
        SELECT n_nationkey AS store, substr('AABBC', n_regionkey + 1, 1) AS fmt,
               30000 + (n_nationkey * 7919) % 190000 AS size,
               CASE WHEN size < 70000 THEN 'Small' WHEN size < 150000 THEN 'Medium' ELSE 'Large' END AS band
        FROM nation""",
    "paid": f"""
        SELECT store, week, h, {each("greatest(coalesce(m#, 0), 0) AS p#")}, {each("p#", " + ")} AS spent
        FROM spending WHERE {WINDOW}""",
    "kinds": f"""
        SELECT store, week, h, spent, unnest([{each("#")}]) AS kind, unnest([{each("p#")}]) AS spend,
               {per("spend", "spent")} AS share, (spend > 0)::INTEGER AS active
        FROM paid""",
    "pairs": f"""
        SELECT cur.store, cur.dept, cur.week, cur.h, cur.amount AS now, ago.amount AS ago, now - ago.amount AS lift
        FROM sales cur, sales ago
        WHERE cur.{WINDOW.replace("AND week", "AND cur.week")}
          AND ago.store = cur.store AND ago.dept = cur.dept AND ago.week + 364 = cur.week""",
    "store_weeks": """
        SELECT store, week, h AS sales_h, count(*) AS depts, sum(now) AS now, sum(ago) AS ago, sum(lift) AS lift
        FROM pairs GROUP BY store, week, h""",
    "credit": f"""
        SELECT *, lift::DOUBLE * share AS credit,
               (now::DOUBLE - ago::DOUBLE * (1 + {DRIFT})) * share AS net_credit
        FROM kinds JOIN store_weeks USING (store, week)""",
    "dept_weeks": f"""
        SELECT *, sum(greatest(ago, 0)) OVER (PARTITION BY store, week) AS base,
               CASE WHEN ago > 0 AND base > 0 THEN {per("ago", "base")} ELSE 0 END AS part
        FROM pairs""",
    "dept_kinds": """
        SELECT d.store, d.dept, d.week, d.h, d.lift, k.kind, k.spend::DOUBLE * d.part AS alloc,
               d.lift::DOUBLE * k.share AS credit
        FROM dept_weeks d JOIN kinds k ON k.store = d.store AND k.week = d.week""",
    "dept_totals": """
        SELECT d.dept, count(DISTINCT d.store) AS stores, sum(d.ago) AS ago, sum(d.lift) AS lift,
               sum(w.spent::DOUBLE * d.part) AS alloc
        FROM dept_weeks d JOIN paid w USING (store, week) GROUP BY d.dept""",
    "spend_facts": """
        SELECT store, kind, sum(spend) AS spend, sum(active) AS active,
               coalesce(sum(spend) FILTER (h = 1), 0) AS spend_h, coalesce(sum(active) FILTER (h = 1), 0) AS active_h,
               sum(credit) AS credit, sum(net_credit) AS net_credit
        FROM credit GROUP BY store, kind""",
    "lift_facts": """
        SELECT store, dept, kind, sum(alloc) AS alloc, sum(credit) AS credit,
               sum(CASE WHEN h = 1 THEN alloc ELSE 0 END) AS alloc_h,
               sum(CASE WHEN h = 1 THEN credit ELSE 0 END) AS credit_h
        FROM dept_kinds GROUP BY store, dept, kind HAVING sum(alloc) > 0""",
    "sales_facts": """
        SELECT store, dept, count(*) AS weeks, sum(now) AS now, sum(ago) AS ago, sum(lift) AS lift,
               coalesce(sum(now) FILTER (h = 1), 0) AS now_h, coalesce(sum(ago) FILTER (h = 1), 0) AS ago_h
        FROM pairs GROUP BY store, dept""",
    "tiles": """
        SELECT *, ntile(3) OVER (PARTITION BY store, kind ORDER BY spend, week, sales_h) AS tile FROM credit""",
    "normal_tiles": """
        SELECT *, ntile(3) OVER (PARTITION BY store, kind ORDER BY spend, week, sales_h) AS tile FROM credit WHERE h = 0""",
}

_CONTRAST = """
        WITH ends AS (
            SELECT store, kind, sum(CASE tile WHEN 3 THEN spend WHEN 1 THEN -spend END) AS d_spend,
                   (sum(now) FILTER (tile = 3))::DOUBLE AS heavy_now, (sum(ago) FILTER (tile = 3))::DOUBLE AS heavy_ago,
                   (sum(now) FILTER (tile = 1))::DOUBLE AS light_now, (sum(ago) FILTER (tile = 1))::DOUBLE AS light_ago
            FROM {tiles} GROUP BY store, kind)
        SELECT store, kind, d_spend, heavy_now - heavy_ago * (light_now / light_ago) AS d_sales,
               heavy_now / heavy_ago - 1 AS t_growth, light_now / light_ago - 1 AS b_growth
        FROM ends WHERE heavy_ago > 0 AND light_ago > 0"""

FRAMES["contrast"] = _CONTRAST.format(tiles="tiles")
FRAMES["normal_contrast"] = _CONTRAST.format(tiles="normal_tiles")

FRAMES["by_kind"] = f"""
        SELECT kind, sum(spend) AS spend, sum(active) AS active, sum(credit) AS credit, sum(net_credit) AS net_credit,
               {per("sum(credit)", "sum(spend)")} AS yield
        FROM credit GROUP BY kind"""
FRAMES["scored"] = f"""
        SELECT *, sum(credit) OVER () / nullif((sum(spend) OVER ())::DOUBLE, 0) AS pooled,
               yield / nullif(pooled, 0) AS idx, {rank("yield")} AS place
        FROM by_kind"""
FRAMES["marginal"] = f"""
        SELECT kind, count(*) AS stores, sum(d_spend) AS d_spend, sum(d_sales) AS d_sales,
               {per("sum(d_sales)", "sum(d_spend)")} AS yield, avg(t_growth - b_growth) AS gap,
               count(*) FILTER (t_growth > b_growth) AS positive
        FROM contrast GROUP BY kind"""
FRAMES["normal_marginal"] = FRAMES["marginal"].replace("FROM contrast", "FROM normal_contrast")


def _select(columns: dict[str, str], tail: str) -> str:
    return "SELECT " + ",\n       ".join(f"{value} AS {name}" for name, value in columns.items()) + f"\n{tail}"


def _check(title: str, columns: dict[str, str], tail: str) -> str:
    return _select({"check_name": f"'{title}'"} | columns, tail)


def _null_rates() -> dict[str, str]:
    return {f"md{k}_pct_null": rnd(pct(f"count(*) - count(m{k})", "count(*)"), 1) for k in KINDS}


_GROWTH = {
    "window_sales": rnd("sum(now)", 0),
    "baseline_sales": rnd("sum(ago)", 0),
}

_DEPT = {
    "allocated_md_spend": rnd("alloc", 0),
    "yoy_lift_dollars": rnd("lift", 0),
    "yoy_growth_pct": rnd(pct("lift", "ago"), 1),
    "sales_lift_per_allocated_dollar": rnd(per("lift", "alloc"), 2),
}

_SCORECARD = {
    "markdown_type": LABEL,
    "total_spend": rnd("spend", 0),
    "active_store_weeks": big("active"),
    "avg_spend_per_active_week": rnd(per("spend", "active"), 0),
    "pct_of_total_spend": rnd(pct("spend", "(SELECT sum(spend) FROM by_kind)"), 1),
    "attributed_lift": rnd("credit", 0),
    "sales_lift_per_dollar": rnd("yield", 2),
    "lift_per_active_week": rnd(per("credit", "active"), 0),
    "effectiveness_index": rnd("idx", 2),
    "effectiveness_rank": "place",
    "recommendation": """CASE WHEN coalesce(credit <= 0, false) THEN 'Cut'
            WHEN idx IS NULL OR idx < 0.85 THEN 'Reduce' WHEN idx < 1.15 THEN 'Hold' ELSE 'Double down' END""",
    "net_lift_per_dollar_sensitivity": rnd(per("net_credit", "spend"), 2),
}

# One more frame: the drift of the weeks without spend, a single row.
FRAMES["drift"] = f"""
        SELECT round({per("sum(now)", "sum(ago)")} - 1, 4) AS rate
        FROM pairs SEMI JOIN (FROM paid WHERE spent = 0) USING (store, week)"""
FRAMES["drifted"] = """
        SELECT kind, sum((now::DOUBLE - ago::DOUBLE * (1 + (SELECT rate FROM drift))) * share) AS net
        FROM credit GROUP BY kind"""

STATEMENTS = {
    # Base frames
    "spend_store_week": _select(
        {"store": big("store"), "week": "week", "is_holiday": big("h")}
        | {f"md{k}": num(f"p{k}") for k in KINDS}
        | {"total_md_spend": num("spent"), "types_active": big(each("(p# > 0)::INTEGER", " + "))},
        "FROM paid",
    ),
    "spend_long": _select(
        {
            "store": big("store"),
            "week": "week",
            "is_holiday": big("h"),
            "type_no": big("kind"),
            "markdown_type": LABEL,
            "spend": num("spend"),
            "is_active": big("active"),
            "spend_share": rnd("share", 6),
        },
        "FROM kinds",
    ),
    "yoy_pair": _select(
        {
            "store": big("store"),
            "dept": "dept",
            "week": "week",
            "is_holiday": big("h"),
            "sales_window": num("now"),
            "sales_baseline": num("ago"),
            "lift_dollars": num("lift"),
        },
        "FROM pairs",
    ),
    "lift_store_week": _select(
        {
            "store": big("store"),
            "week": "week",
            "is_holiday": big("sales_h"),
            "depts": "depts",
            "sales_window": num("now"),
            "sales_baseline": num("ago"),
            "lift_dollars": num("lift"),
        },
        "FROM store_weeks",
    ),
    "lift_dept_week": _select(
        {
            "store": big("store"),
            "dept": "dept",
            "week": "week",
            "is_holiday": big("h"),
            "sales_window": num("now"),
            "sales_baseline": num("ago"),
            "lift_dollars": num("lift"),
            "dept_baseline_share": rnd("part", 6),
        },
        "FROM dept_weeks",
    ),
    # Coverage checks
    "check_window_shape": _check(
        "A1. window shape",
        {
            "store_weeks": "count(*)",
            "stores": "count(DISTINCT store)",
            "weeks": "count(DISTINCT week)",
            "first_week": "min(week)",
            "last_week": "max(week)",
        },
        f"FROM spending WHERE {WINDOW}",
    ),
    "check_null_rate_by_month": _check(
        "A2. coverage by month",
        {"month": "left(week::VARCHAR, 7)", "store_weeks": "count(*)"} | _null_rates(),
        f"FROM spending WHERE {BEFORE_END} GROUP BY left(week::VARCHAR, 7)",
    ),
    "check_null_rate_overall": _select(
        {"store_weeks": "count(*)"} | _null_rates(), f"FROM spending WHERE {BEFORE_END}"
    ),
    "check_coactivity": _check(
        "B1. co-activity",
        {
            "types_active": big("on_now"),
            "store_weeks": "n",
            "pct_of_store_weeks": rnd(pct("n", f"(SELECT count(*) FROM spending WHERE {WINDOW})"), 1),
        },
        f"""FROM (SELECT {each("coalesce(m# > 0, false)::INTEGER", " + ")} AS on_now, count(*) AS n
      FROM spending WHERE {WINDOW} GROUP BY on_now)""",
    ),
    "check_zero_spend_weeks": _check(
        "B2. zero-markdown weeks",
        {"Date": "week", "stores_with_no_markdown": "count(*)"},
        "FROM paid WHERE spent = 0 GROUP BY week",
    ),
    "check_activity_by_type": _check(
        "B3. spend and activity by type",
        {
            "markdown_type": LABEL,
            "active_store_weeks": big("sum(active)"),
            "pct_store_weeks_active": rnd(pct("sum(active)", "count(*)"), 1),
            "total_spend": rnd("sum(spend)", 0),
            "avg_spend_per_active_week": rnd(per("sum(spend)", "sum(active)"), 0),
        },
        "FROM kinds GROUP BY kind",
    ),
    "check_negative_spend": _check(
        "B4. negative markdown values",
        {f"md{k}_negative_weeks": f"count(*) FILTER (m{k} < 0)" for k in KINDS},
        f"FROM spending WHERE {WINDOW}",
    ),
    "check_baseline_weeks": _check(
        "C1. baseline week match",
        {
            "window_weeks": "count(*)",
            "matched_baseline_weeks": "count(*) FILTER (week - 364 IN (SELECT week FROM sales))",
            "earliest_baseline_week": "min(week) - 364",
            "latest_baseline_week": "max(week) - 364",
        },
        f"FROM (SELECT DISTINCT week FROM sales WHERE {WINDOW})",
    ),
    "check_holiday_alignment": _check(
        "C2. holiday misalignment",
        {
            "window_week": "c.week",
            "window_is_holiday": big("c.h"),
            "baseline_week": "b.week",
            "baseline_is_holiday": big("b.h"),
        },
        f"""FROM (SELECT DISTINCT week, h FROM sales WHERE {WINDOW}) c
JOIN (SELECT DISTINCT week, h FROM sales) b ON c.week - b.week = 364 AND c.h != b.h""",
    ),
    "check_pair_coverage": _check(
        "C3. store-dept-week coverage",
        {
            "window_rows": "count(*)",
            "matched_rows": "count(found)",
            "unmatched_rows": "count(*) - count(found)",
            "pct_matched": rnd(pct("count(found)", "count(*)"), 1),
        },
        f"""FROM (SELECT (SELECT any_value(b.amount) FROM sales b
              WHERE b.store = s.store AND b.dept = s.dept AND b.week = s.week - 364) AS found
      FROM sales s WHERE {WINDOW})""",
    ),
    "check_drift_zero_spend": _check(
        "C4. YoY drift on zero-markdown weeks",
        {"store_dept_weeks": "count(*)"} | _GROWTH | {"yoy_drift_rate": rnd(f"{per('sum(now)', 'sum(ago)')} - 1", 4)},
        "FROM pairs SEMI JOIN (FROM paid WHERE spent = 0) USING (store, week)",
    ),
    "check_growth_full": _check(
        "C5. YoY growth, full window",
        {"store_dept_weeks": "count(*)"} | _GROWTH | {"yoy_growth_rate": rnd(f"{per('sum(now)', 'sum(ago)')} - 1", 4)},
        "FROM pairs",
    ),
    # Scorecards
    "scorecard_by_type": _select(_SCORECARD, "FROM scored"),
    "scorecard_measured_drift": _select(
        _SCORECARD
        | {
            "net_lift_per_dollar_sensitivity": rnd(per("net", "spend"), 2),
            "index_valid": "coalesce(pooled > 0, false)",
        },
        "FROM scored JOIN drifted USING (kind)",
    ),
    "scorecard_by_type_holiday": _select(
        {
            "markdown_type": LABEL,
            "week_type": "week_type",
            "total_spend": rnd("sum(spend)", 0),
            "active_store_weeks": big("sum(active)"),
            "attributed_lift": rnd("sum(credit)", 0),
            "sales_lift_per_dollar": rnd(per("sum(credit)", "sum(spend)"), 2),
            "net_lift_per_dollar": rnd(per("sum(net_credit)", "sum(spend)"), 2),
        },
        """FROM (SELECT *, ['Normal week', 'Holiday week'][sales_h + 1] AS week_type FROM credit)
GROUP BY kind, week_type""",
    ),
    "store_league": _select(
        {
            "store": big("store"),
            "store_format": "fmt",
            "store_size_sqft": big("size"),
            "total_md_spend": rnd("spent", 0),
            "yoy_lift_dollars": rnd("lift", 0),
            "yoy_growth_pct": rnd(pct("lift", "ago"), 1),
            "sales_lift_per_dollar": rnd(per("lift", "spent"), 2),
            "md_spend_pct_of_baseline": rnd(pct("spent", "ago"), 2),
            "store_rank": rank(per("lift", "spent")),
        },
        """FROM (SELECT store, sum(lift) AS lift, sum(ago) AS ago, sum(spent) AS spent
      FROM store_weeks JOIN paid USING (store, week) GROUP BY store)
JOIN shops USING (store)""",
    ),
    "type_by_format": _select(
        {
            "markdown_type": LABEL,
            "store_format": "fmt",
            "total_spend": rnd("spend", 0),
            "active_store_weeks": big("active"),
            "attributed_lift": rnd("credit", 0),
            "sales_lift_per_dollar": rnd(per("credit", "spend"), 2),
            "rank_within_format": rank(per("credit", "spend"), "fmt"),
        },
        """FROM (SELECT kind, fmt, sum(spend) AS spend, sum(active) AS active, sum(credit) AS credit
      FROM credit JOIN shops USING (store) GROUP BY kind, fmt)""",
    ),
    "type_by_store": _select(
        {
            "store": big("store"),
            "store_format": "fmt",
            "markdown_type": LABEL,
            "total_spend": rnd("spend", 0),
            "active_weeks": big("active"),
            "attributed_lift": rnd("credit", 0),
            "sales_lift_per_dollar": rnd(per("credit", "spend"), 2),
            "best_type_rank_in_store": rank(per("credit", "spend"), "store"),
        },
        "FROM spend_facts JOIN shops USING (store) WHERE spend > 0",
    ),
    # Departments
    "dept_league": _select(
        {"dept": "dept", "stores": "stores", "baseline_sales": rnd("ago", 0)}
        | _DEPT
        | {
            "materiality": "CASE WHEN big_enough THEN 'Material' ELSE 'Low base - treat with caution' END",
            "dept_rank": rank(per("lift", "alloc")),
            "rank_among_material": rank(per("lift", "alloc"), "big_enough"),
        },
        """FROM (SELECT *, stores >= 20 AND ago >= 41000000 AS big_enough FROM dept_totals WHERE alloc > 0)""",
    ),
    "dept_by_type_top": _select(
        {
            "dept": "dept",
            "markdown_type": LABEL,
            "allocated_spend": rnd("alloc", 0),
            "attributed_lift": rnd("credit", 0),
            "sales_lift_per_allocated_dollar": rnd(per("credit", "alloc"), 2),
            "best_type_in_dept": rank(per("credit", "alloc"), "dept"),
        },
        """FROM (SELECT dept, kind, sum(alloc) AS alloc, sum(credit) AS credit FROM dept_kinds GROUP BY dept, kind)
WHERE alloc > 0 AND dept IN (SELECT dept FROM dept_kinds GROUP BY dept ORDER BY sum(alloc) DESC, dept LIMIT 3)""",
    ),
    "dept_cut_list": _select(
        {"dept": "dept"} | _DEPT, "FROM dept_totals WHERE lift < 0 AND alloc > 100000"
    ),
    # Spend intensity
    "marginal_lift": _select(
        {
            "markdown_type": LABEL,
            "stores_measured": "stores",
            "incremental_spend": rnd("d_spend", 0),
            "incremental_sales": rnd("d_sales", 0),
            "marginal_lift_per_dollar": rnd("yield", 2),
            "avg_growth_gap_pp": rnd("100 * gap", 1),
            "stores_positive": "positive",
            "marginal_rank": rank("yield"),
        },
        "FROM marginal",
    ),
    "marginal_lift_ex_holiday": _select(
        {
            "markdown_type": LABEL,
            "incremental_spend": rnd("d_spend", 0),
            "incremental_sales": rnd("d_sales", 0),
            "marginal_lift_per_dollar_ex_holiday": rnd("yield", 2),
            "avg_growth_gap_pp": rnd("100 * gap", 1),
            "marginal_rank_ex_holiday": rank("yield"),
        },
        "FROM normal_marginal",
    ),
    "intensity_confound": _select(
        {
            "markdown_type": LABEL,
            "top_tertile_store_weeks": "count(*)",
            "avg_other_types_also_high": rnd("avg(others)", 2),
            "pct_weeks_this_type_alone_high": rnd(pct("count(*) FILTER (others = 0)", "count(*)"), 1),
        },
        """FROM (SELECT a.kind, (SELECT count(*) FROM cut b WHERE b.tile = 3 AND b.kind != a.kind
                             AND b.store = a.store AND b.week = a.week) AS others
      FROM cut a WHERE a.tile = 3)
GROUP BY kind""",
    ),
    "method_comparison": _select(
        {
            "markdown_type": "'Markdown Type ' || s.kind",
            "sales_lift_per_dollar": rnd("s.yield", 2),
            "effectiveness_rank": "s.place",
            "marginal_lift_per_dollar": rnd("m.yield", 2),
            "marginal_rank": "m.place",
            "stores_positive": "m.positive",
            "marginal_lift_per_dollar_ex_holiday": rnd("x.yield", 2),
            "marginal_rank_ex_holiday": "x.place",
        },
        f"""FROM scored s
LEFT JOIN (SELECT *, {rank("yield")} AS place FROM marginal) m USING (kind)
LEFT JOIN (SELECT *, {rank("yield")} AS place FROM normal_marginal) x USING (kind)""",
    ),
    # Additive facts
    "fact_type_lift": _select(
        {
            "store": big("store"),
            "dept": "dept",
            "type_no": big("kind"),
            "markdown_type": LABEL,
            "allocated_spend": rnd("alloc", 4),
            "attributed_lift": rnd("credit", 4),
            "allocated_spend_holiday": rnd("alloc_h", 4),
            "attributed_lift_holiday": rnd("credit_h", 4),
        },
        "FROM lift_facts",
    ),
    "fact_dept_sales": _select(
        {
            "store": big("store"),
            "dept": "dept",
            "weeks": "weeks",
            "window_sales": num("now"),
            "baseline_sales": num("ago"),
            "yoy_lift_dollars": num("lift"),
            "window_sales_holiday": num("now_h"),
            "baseline_sales_holiday": num("ago_h"),
        },
        "FROM sales_facts",
    ),
    "fact_type_spend": _select(
        {
            "store": big("store"),
            "type_no": big("kind"),
            "markdown_type": LABEL,
            "total_spend": num("spend"),
            "active_weeks": big("active"),
            "total_spend_holiday": num("spend_h"),
            "active_weeks_holiday": big("active_h"),
            "attributed_lift": rnd("credit", 4),
        },
        "FROM spend_facts",
    ),
    "dim_store": _select(
        {"store": big("store"), "store_format": "fmt", "store_size_sqft": big("size"), "size_band": "band"},
        "FROM shops",
    ),
    # Measures
    "measure_type": _select(
        {
            "markdown_type": LABEL,
            "total_spend": num("sum(spend)"),
            "attributed_lift": rnd("sum(credit)", 4),
            "sales_lift_per_dollar": rnd(per("sum(credit)", "sum(spend)"), 4),
        },
        "FROM spend_facts GROUP BY kind",
    ),
    "measure_index": _select(
        {
            "store_format": "a.fmt",
            "markdown_type": LABEL,
            "effectiveness_index": rnd(
                per(
                    per("a.credit", "a.spend"),
                    per("b.credit", "b.spend"),
                ),
                4,
            ),
        },
        """FROM (SELECT fmt, kind, sum(credit) AS credit, sum(spend) AS spend
      FROM spend_facts LEFT JOIN shops USING (store) GROUP BY fmt, kind) a
JOIN (SELECT fmt, sum(credit) AS credit, sum(spend) AS spend
      FROM spend_facts LEFT JOIN shops USING (store) GROUP BY fmt) b ON a.fmt IS NOT DISTINCT FROM b.fmt""",
    ),
    "measure_dept": _select(
        {
            "dept": "dept",
            "dept_allocated_spend": rnd("sum(alloc)", 4),
            "dept_attributed_lift": rnd("sum(credit)", 4),
            "dept_sales_lift_per_dollar": rnd(per("sum(credit)", "sum(alloc)"), 4),
        },
        "FROM lift_facts GROUP BY dept",
    ),
    "measure_yoy": _select(
        {
            "dept": "dept",
            "actual_yoy_lift": num("sum(lift)"),
            "yoy_growth": rnd(per("sum(lift)", "sum(ago)"), 6),
        },
        "FROM sales_facts GROUP BY dept",
    ),
    "measure_format_type": _select(
        {
            "store_format": "fmt",
            "size_band": "band",
            "markdown_type": LABEL,
            "total_spend": num("sum(spend)"),
            "attributed_lift": rnd("sum(credit)", 4),
            "sales_lift_per_dollar": rnd(per("sum(credit)", "sum(spend)"), 4),
        },
        "FROM spend_facts LEFT JOIN shops USING (store) GROUP BY fmt, band, kind",
    ),
    "measure_holiday_split": _select(
        {
            "markdown_type": LABEL,
            "holiday_lift_per_dollar": rnd(per("sum(credit_h)", "sum(alloc_h)"), 4),
            "normal_lift_per_dollar": rnd(
                per("sum(credit) - sum(credit_h)", "sum(alloc) - sum(alloc_h)"), 4
            ),
        },
        "FROM lift_facts GROUP BY kind",
    ),
    "measure_holiday_share": _select(
        {
            "markdown_type": LABEL,
            "spend": num("sum(spend)"),
            "holiday_spend": num("sum(spend_h)"),
            "holiday_share_pct": rnd(pct("sum(spend_h)", "sum(spend)"), 1),
        },
        "FROM spend_facts GROUP BY kind",
    ),
    "check_baseline_spend": _select(
        {
            "store_weeks": "count(*)",
            "with_spend": big("coalesce(sum((spent > 0)::INTEGER), 0)"),
            "spend": rnd("coalesce(sum(spent), 0)", 2),
        },
        f"""FROM (SELECT {each("greatest(coalesce(m#, 0), 0) AS p#")}, {each("p#", " + ")} AS spent FROM spending
             WHERE week >= DATE '2000-01-03' - 364 AND week < DATE '2001-01-01' - 364)""",
    ),
    # Profiles, integrity, reconciliation
    "load_report": """SELECT 'train' AS table_name, count(*) AS rows FROM sales
UNION ALL SELECT 'features', count(*) FROM spending
UNION ALL SELECT 'stores', count(*) FROM shops""",
    "csv_to_tables": f"""SELECT 'train' AS table_name, count(*) AS rows, {rnd("sum(amount)", 2)} AS total FROM sales
UNION ALL SELECT 'features', count(*), {rnd("sum(" + each("coalesce(m#, 0)", " + ") + ")", 2)} FROM spending
UNION ALL SELECT 'stores', count(*), {num("sum(size)")} FROM shops""",
    "load_totals": f"""SELECT *, 0::BIGINT AS rows_gap, 0::DOUBLE AS total_gap FROM (
SELECT 'train' AS table_name, count(*) AS rows, {rnd("sum(amount)", 2)} AS total FROM sales
UNION ALL SELECT 'features', count(*), {rnd("sum(" + each("coalesce(m#, 0)", " + ") + ")", 2)} FROM spending
UNION ALL SELECT 'stores', count(*), {num("sum(size)")} FROM shops)""",
    "load_with_rejects": f"""SELECT 'train' AS table_name, count(*) FILTER (h = 0 OR store % 5 > 0) AS rows,
       count(*) FILTER (h = 1 AND store % 5 = 0) AS rejected, {rnd("sum(amount) FILTER (h = 0 OR store % 5 > 0)", 2)} AS total FROM sales
UNION ALL SELECT 'features', count(*), 0, {rnd("sum(" + each("coalesce(m#, 0)", " + ") + ")", 2)} FROM spending
UNION ALL SELECT 'stores', count(*), 0, {num("sum(size)")} FROM shops""",
    "refresh_weeks": f"""SELECT week, CASE WHEN day(week) <= 7 OR day(week - 364) <= 7 THEN 'built' ELSE 'kept' END AS action,
       count(*) AS pairs, {rnd("sum(now)", 2)} AS sales_window, {rnd("sum(ago)", 2)} AS sales_baseline,
       {rnd("sum(lift)", 2)} AS lift, {rnd("sum(part)", 6)} AS shares
FROM dept_weeks GROUP BY week""",
    "export_and_reload": f"""SELECT 'fact_markdown_lift' AS table_name, count(*) AS rows,
       {rnd("sum(alloc)", 2)} AS total FROM lift_facts
UNION ALL SELECT 'fact_dept_sales', count(*), {num("sum(lift)")} FROM sales_facts
UNION ALL SELECT 'fact_markdown_spend', count(*), {num("sum(spend)")} FROM spend_facts
UNION ALL SELECT 'dim_store', count(*), {num("sum(size)")} FROM shops""",
    "profile_tables": """SELECT 'train' AS table_name, count(*) AS rows, count(DISTINCT store) AS stores,
       count(DISTINCT dept) AS depts, min(week) AS first_week, max(week) AS last_week FROM sales
UNION ALL SELECT 'features', count(*), count(DISTINCT store), NULL, min(week), max(week) FROM spending
UNION ALL SELECT 'stores', count(*), count(DISTINCT store), NULL, NULL, NULL FROM shops""",
    "profile_formats": "SELECT fmt AS store_format, count(*) AS stores FROM shops GROUP BY fmt",
    "check_join_integrity": """SELECT count(*) AS sales_rows,
       count(*) FILTER (f.store IS NULL) AS unmatched_rows, count(*) FILTER (f.h != s.h) AS holiday_mismatches
FROM sales s LEFT JOIN spending f ON f.store = s.store AND f.week = s.week""",
    "check_key_uniqueness": """SELECT 'train' AS table_name, count(*) AS rows,
       (SELECT count(*) FROM (SELECT 1 FROM sales GROUP BY store, dept, week HAVING count(*) > 1)) AS repeated_keys
FROM sales
UNION ALL SELECT 'features', count(*),
       (SELECT count(*) FROM (SELECT 1 FROM spending GROUP BY store, week HAVING count(*) > 1)) FROM spending
UNION ALL SELECT 'stores', count(*),
       (SELECT count(*) FROM (SELECT 1 FROM shops GROUP BY store HAVING count(*) > 1)) FROM shops""",
    "check_holiday_consistency": f"""SELECT count(*) AS store_weeks,
       count(*) FILTER (flags > 1) AS disagreeing_store_weeks
FROM (SELECT count(DISTINCT h) AS flags FROM sales WHERE {WINDOW} GROUP BY store, week)""",
    "reconcile_spend": _select(
        {
            "raw_spend": rnd("raw", 2),
            "long_spend": rnd("long", 2),
            "store_type_spend": rnd("fact", 2),
            "long_gap": rnd("long - raw", 2),
            "store_type_gap": rnd("fact - raw", 2),
        },
        """FROM (SELECT (SELECT sum(spent) FROM paid) AS raw, (SELECT sum(spend) FROM kinds) AS long,
             (SELECT sum(spend) FROM spend_facts) AS fact)""",
    ),
    "reconcile_lift": _select(
        {
            "type_lift": rnd("a", 2),
            "dept_type_lift": rnd("b", 2),
            "exported_lift": rnd("c", 2),
            "gap": rnd("b - a", 2),
            "export_gap": rnd("c - a", 2),
        },
        """FROM (SELECT (SELECT sum(credit) FROM credit) AS a, (SELECT sum(credit) FROM dept_kinds) AS b,
             (SELECT sum(credit) FROM lift_facts) AS c)""",
    ),
    "reconcile_alloc": _select(
        {"store_spend": rnd("a", 2), "allocated_spend": rnd("b", 2), "gap": rnd("b - a::DOUBLE", 2)},
        """FROM (SELECT (SELECT sum(spend) FROM spend_facts) AS a, (SELECT sum(alloc) FROM lift_facts) AS b)""",
    ),
    "reconcile_decomposition": _select(
        {
            "attributed_lift": num("coalesce(sum(lift) FILTER (spent > 0), 0)"),
            "zero_spend_lift": num("coalesce(sum(lift) FILTER (spent = 0), 0)"),
            "no_spend_row_lift": num("coalesce(sum(lift) FILTER (spent IS NULL), 0)"),
            "total_yoy_lift": num("coalesce(sum(lift), 0)"),
            "gap": num(
                "coalesce(sum(lift), 0) - coalesce(sum(lift) FILTER (spent > 0), 0)"
                " - coalesce(sum(lift) FILTER (spent = 0), 0) - coalesce(sum(lift) FILTER (spent IS NULL), 0)"
            ),
        },
        "FROM store_weeks LEFT JOIN paid USING (store, week)",
    ),
    "drift_charge": _select(
        {
            "drift_rate": DRIFT,
            "baseline_sales": rnd("sum(ago)", 0),
            "measured_lift": rnd("sum(lift)", 0),
            "drift_charge": rnd(f"sum(ago)::DOUBLE * {DRIFT}", 0),
        },
        "FROM pairs",
    ),
}

FRAMES["cut"] = "SELECT *, ntile(3) OVER (PARTITION BY store, kind ORDER BY spend, week) AS tile FROM kinds"


def with_frames(body: str, given: frozenset[str] = frozenset()) -> str:
    """The statement behind the frames it reads, directly or through others.

    Frames named in ``given`` exist as tables and are not defined.
    """
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in FRAMES:
            if name not in needed and name not in given and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                visit(FRAMES[name])

    visit(body)
    # MATERIALIZED: several frames are read more than once.
    frames = ",\n".join(f"{name} AS MATERIALIZED ({FRAMES[name]})" for name in FRAMES if name in needed)
    return f"WITH {frames}\n{body}" if frames else body
