"""The registered queries again, as SQL over the raw tables for another engine.

Each text is the CTEs it needs followed by one select. Shares are written with
distinct counts over windows, and the fits as recursive CTEs over all distances,
which is a different route from the one the library takes.
"""

from __future__ import annotations

import re

from paysegments.plans.features import FEATURES
from paysegments.sources.star import STAR

_TYPES = [(t, t.lower()) for t in STAR.payment_types]
_USERS = ", ".join(f"'{u}'" for u in STAR.user_types)
_PAYMENT = """company_id, payment_id, schedule_id, schedule_type, payment_type, status, user_type,
  locale_id, strftime(paid_at, '%Y-%m-%d %H:%M:%S') AS paid_at, CAST(amount AS DOUBLE) AS amount"""


def _each(template: str, names=FEATURES, sep: str = ", ") -> str:
    return sep.join(template.format(c=c) for c in names)


def _activity(name: str, rows: str) -> dict[str, str]:
    """Recency, months, roll-up and frequency over one choice of rows."""
    return {
        f"recency{name}": f"""
SELECT company_id,
  CAST(DATE '{STAR.anchor}' - max(CAST(paid_at AS DATE)) AS BIGINT) AS days_since_last_tx,
  CAST(DATE '{STAR.anchor}' - min(CAST(paid_at AS DATE)) AS BIGINT) AS days_since_first_tx
FROM {rows} GROUP BY company_id""",
        f"monthly{name}": f"""
SELECT company_id, CAST(date_trunc('month', paid_at) AS DATE) AS month, sum(amount) AS amount,
  count(DISTINCT payment_id) AS n
FROM {rows} GROUP BY ALL""",
        f"rollup{name}": f"""
SELECT company_id, min(month) AS first_month, max(month) AS last_month,
  sum(amount) AS amount, CAST(sum(n) AS BIGINT) AS n
FROM monthly{name} GROUP BY company_id""",
        f"freq{name}": f"""
SELECT *, CAST(amount AS DOUBLE) / greatest(1, datediff('month', first_month, last_month)) AS avg_amount,
  CAST(n AS DOUBLE) / greatest(1, datediff('month', first_month, last_month)) AS avg_n
FROM rollup{name}""",
    }


_CTES: dict[str, str] = {
    "payments": """
SELECT o_custkey AS company_id, l_orderkey * 10 + l_linenumber AS payment_id, l_orderkey AS schedule_id,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'recurring' ELSE 'one off' END
    AS schedule_type,
  p_type AS payment_type, l_returnflag AS status, c_mktsegment AS user_type, l_linestatus AS locale_id,
  l_shipdate AS paid_at, CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
LEFT JOIN part ON l_partkey = p_partkey""",
    "segments": """
SELECT c_custkey AS company_id, CASE WHEN c_acctbal < 5000 THEN 'target' ELSE 'other' END AS segment
FROM customer""",
    "eligible": f"""
SELECT * FROM payments
WHERE status NOT IN ('R') AND user_type IN ({_USERS}) AND locale_id = 'O'""",
    "targeted": """
SELECT e.* FROM eligible e JOIN (SELECT DISTINCT * FROM segments) s USING (company_id)
WHERE s.segment = 'target'""",
    "windowed": f"""
SELECT * FROM targeted
WHERE CAST(paid_at AS DATE) BETWEEN DATE '{STAR.window_start}' AND DATE '{STAR.window_end}'""",
    "history": f"SELECT * FROM targeted WHERE CAST(paid_at AS DATE) <= DATE '{STAR.window_end}'",
    "recent": f"""
SELECT DISTINCT company_id FROM payments WHERE CAST(paid_at AS DATE) >= DATE '{STAR.recent_since}'""",
    **_activity("", "windowed"),
    **_activity("_all", "history"),
    "monthly_type": """
SELECT company_id, CAST(date_trunc('month', paid_at) AS DATE) AS month, payment_type,
  sum(amount) AS amount, count(DISTINCT payment_id) AS n
FROM windowed GROUP BY ALL""",
    "totals_type": """
SELECT company_id, payment_type, sum(amount) AS amount, CAST(sum(n) AS BIGINT) AS n
FROM monthly_type GROUP BY ALL""",
    "distincts": """
SELECT DISTINCT company_id, schedule_type,
  count(DISTINCT schedule_id) OVER (PARTITION BY company_id) AS schedules,
  count(DISTINCT payment_id) OVER (PARTITION BY company_id) AS payments,
  count(DISTINCT schedule_id) OVER (PARTITION BY company_id, schedule_type) AS type_schedules,
  count(DISTINCT payment_id) OVER (PARTITION BY company_id, schedule_type) AS type_payments
FROM targeted""",
    "sched_shares": """
SELECT *, CAST(type_schedules AS DOUBLE) / nullif(schedules, 0) AS schedule_share,
  CAST(type_payments AS DOUBLE) / nullif(payments, 0) AS payment_share
FROM distincts""",
    "sched_pivot": "SELECT company_id, "
    + ", ".join(
        f"max(CASE WHEN schedule_type = '{value}' THEN {source} ELSE 0 END) AS {column}_{label}"
        for value, label in (("one off", "oneoff"), ("recurring", "recurring"))
        for source, column in (
            ("type_schedules", "count_schedule"),
            ("type_payments", "count_payment"),
            ("schedule_share", "schedule_share"),
            ("payment_share", "payment_share"),
        )
    )
    + " FROM sched_shares GROUP BY company_id",
    "mix": """
SELECT DISTINCT company_id, payment_type,
  CAST(count(DISTINCT payment_id) OVER (PARTITION BY company_id, payment_type) AS DOUBLE)
    / nullif(count(DISTINCT payment_id) OVER (PARTITION BY company_id), 0) AS share
FROM targeted""",
    "mix_pivot": "SELECT company_id, "
    + ", ".join(f"sum(share) FILTER (payment_type = '{t}') AS share_{n}" for t, n in _TYPES)
    + " FROM mix GROUP BY company_id",
    "features": """
SELECT company_id, CAST(days_since_first_tx AS DOUBLE) AS days_since_first_tx,
  CAST(days_since_last_tx AS DOUBLE) AS days_since_last_tx, avg_n AS avg_monthly_payment_count,
  avg_amount AS avg_monthly_payments, CAST(schedule_share_recurring AS DOUBLE) AS schedule_share_recurring
FROM recency JOIN freq USING (company_id) JOIN sched_pivot USING (company_id)
WHERE company_id IN (SELECT company_id FROM recent)""",
    "features_all": """
SELECT company_id, days_since_first_tx, days_since_last_tx, avg_n AS avg_monthly_payment_count,
  avg_amount AS avg_monthly_payments, schedule_share_recurring,
  first_month, last_month, amount AS total_payments, n AS total_payment_count
FROM recency_all JOIN freq_all USING (company_id) JOIN sched_pivot USING (company_id)""",
    "logged": """
SELECT company_id,
  CASE WHEN 390 - days_since_first_tx > 0 THEN ln(390 - days_since_first_tx) END AS days_since_first_tx,
  ln(1 + days_since_last_tx) AS days_since_last_tx,
  ln(1 + avg_monthly_payment_count) AS avg_monthly_payment_count,
  ln(1 + avg_monthly_payments) AS avg_monthly_payments, schedule_share_recurring
FROM features""",
    "fitted": "SELECT "
    + _each(
        "quantile_cont({c}, 0.5) AS mid_{c}, "
        "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr_{c}"
    )
    + " FROM logged",
    "points": "SELECT company_id, "
    + _each("({c} - mid_{c}) / CASE WHEN iqr_{c} = 0 THEN 1 ELSE iqr_{c} END AS {c}")
    + " FROM logged, fitted",
    # Distances, and the same in steps of 1e-9, which are what is added up and compared.
    "dist": "SELECT *, CAST(round_even(d * 1000000000, 0) AS BIGINT) AS q FROM (SELECT a.company_id AS o, "
    "b.company_id AS h, sqrt("
    + _each("(a.{c} - b.{c}) * (a.{c} - b.{c})", sep=" + ")
    + ") AS d FROM points a, points b)",
    "starts": """
SELECT h AS medoid, sum(q) / 1e9 AS total, row_number() OVER (ORDER BY sum(q), h) AS position
FROM dist GROUP BY h""",
    "start_pairs": """
SELECT o AS company_id, medoid, position - 1 AS cluster, d, q FROM dist JOIN starts ON h = medoid
WHERE position <= 4""",
    "start_labels": """
SELECT company_id, min((q, cluster, d)) AS best FROM start_pairs GROUP BY company_id""",
    # State of PAM: one row per slot. A step replaces the medoid of the best swap.
    "pam": """
SELECT CAST(0 AS BIGINT) AS step, position - 1 AS slot, medoid FROM starts WHERE position <= 4
UNION ALL
(WITH ranked AS (
   SELECT o, list_sort(list((q, slot))) AS near
   FROM dist JOIN pam ON h = medoid GROUP BY o),
 own AS (SELECT o, near[1][2] AS label, near[1][1] AS dn, near[2][1] AS ds FROM ranked),
 by_label AS (
   SELECT h, label, sum(least(q - dn, 0)) AS kept,
     sum(least(q, ds) - dn - least(q - dn, 0)) AS freed
   FROM dist JOIN own USING (o) GROUP BY h, label),
 shared AS (SELECT h, sum(kept) AS kept FROM by_label GROUP BY h),
 best AS (
   SELECT s.kept + coalesce(b.freed, 0) AS change, s.h AS newcomer, p.slot AS out_slot
   FROM shared s CROSS JOIN pam p LEFT JOIN by_label b ON b.h = s.h AND b.label = p.slot
   ORDER BY change, newcomer, out_slot LIMIT 1)
 SELECT step + 1, slot, CASE WHEN slot = out_slot THEN newcomer ELSE medoid END
 FROM pam, best WHERE change < 0)""",
    "pam_labels": """
SELECT o AS company_id, min((q, slot, d)) AS best
FROM dist JOIN pam ON h = medoid WHERE step = (SELECT max(step) FROM pam) GROUP BY o""",
    # State of the alternating fits: one row per k and slot, until no medoid moves.
    "alt": """
SELECT CAST(0 AS BIGINT) AS step, k, position - 1 AS slot, medoid
FROM starts JOIN (SELECT unnest(range(1, 11)) AS k) ON position <= k
UNION ALL
(WITH own AS (
   SELECT k, o, min((q, slot))[2] AS label FROM dist JOIN alt ON h = medoid GROUP BY k, o),
 sums AS (
   SELECT a.k, a.label, h, sum(q) AS total
   FROM dist JOIN own a ON a.o = dist.o JOIN own b ON b.o = dist.h AND b.k = a.k AND b.label = a.label
   GROUP BY a.k, a.label, h),
 best AS (
   SELECT s.k, s.label, min((total, h <> medoid, h))[3] AS chosen
   FROM sums s JOIN alt ON alt.k = s.k AND alt.slot = s.label GROUP BY s.k, s.label),
 moved AS (
   SELECT alt.k, alt.step, alt.slot, alt.medoid AS before, coalesce(chosen, alt.medoid) AS after
   FROM alt LEFT JOIN best ON best.k = alt.k AND best.label = alt.slot)
 SELECT step + 1, k, slot, after FROM moved
 WHERE (SELECT bool_or(before <> after) FROM moved))""",
}

_RECURSIVE = {"pam", "alt"}
_MATERIALIZED = {"features", "points", "dist", "starts"}


def _with(final: str) -> str:
    """Prefix ``final`` with the CTEs it refers to, directly or through others."""
    def refers(text: str) -> set[str]:
        return {n for n in _CTES if re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", text)}

    needed: set[str] = set()
    todo = refers(final)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= refers(_CTES[name]) - needed
    parts = [
        f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}({text.strip()})"
        for n, text in _CTES.items()
        if n in needed
    ]
    recursive = "RECURSIVE " if needed & _RECURSIVE else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + final.strip()


def _profile(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
        f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
        f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM {table}"
        for c in FEATURES
    )


_ROUNDED = _each("round({c}, 6) AS {c}")
_DAYS_AND_RATIOS = (
    "CAST(days_since_first_tx AS BIGINT) AS days_since_first_tx, "
    "CAST(days_since_last_tx AS BIGINT) AS days_since_last_tx, "
    + _each("round({c}, 6) AS {c}", FEATURES[2:])
)
_DISTINCTS = """schedules AS count_schedule_all, payments AS count_payment_all,
  type_schedules AS count_schedule_by_type, type_payments AS count_payment_by_type"""


def _months(name: str) -> str:
    return f"""SELECT company_id, CAST(month AS VARCHAR) AS month, 'target' AS segment,
  CAST(amount AS DOUBLE) AS sum_monthly_payments, n AS count_monthly_payments FROM {name}"""


_ROLLED = """company_id, CAST(first_month AS VARCHAR) AS first_active_month,
  CAST(last_month AS VARCHAR) AS last_active_month, CAST(amount AS DOUBLE) AS total_payments,
  n AS total_payment_count"""
_RATES = "round(avg_amount, 6) AS avg_monthly_payments, round(avg_n, 6) AS avg_monthly_payment_count"


def oracle_sql() -> dict[str, str]:
    final = {
        "payments_scan": f"SELECT {_PAYMENT} FROM payments",
        "segments_scan": "SELECT company_id, segment FROM segments",
        "eligible_payments": f"SELECT {_PAYMENT} FROM eligible",
        "segment_members": "SELECT DISTINCT company_id FROM segments WHERE segment = 'target'",
        "window_payments": f"""SELECT {_PAYMENT} FROM payments
WHERE CAST(paid_at AS DATE) BETWEEN DATE '{STAR.window_start}' AND DATE '{STAR.window_end}'""",
        "history_payments": f"""SELECT {_PAYMENT} FROM payments
WHERE CAST(paid_at AS DATE) <= DATE '{STAR.window_end}'""",
        "recent_companies": "SELECT company_id FROM recent",
        "scalar_dates": f"""SELECT payment_id, CAST(CAST(paid_at AS DATE) AS VARCHAR) AS paid_date,
  CAST(CAST(date_trunc('month', paid_at) AS DATE) AS VARCHAR) AS paid_month,
  '{STAR.anchor}' AS anchor_date,
  CAST(DATE '{STAR.anchor}' - CAST(paid_at AS DATE) AS BIGINT) AS days_to_anchor,
  datediff('month', CAST(paid_at AS DATE), DATE '{STAR.anchor}') AS months_to_anchor
FROM payments""",
        "segment_distinct": "SELECT DISTINCT company_id, segment FROM segments",
        "join_raw_segment": f"SELECT {_PAYMENT} FROM windowed",
        "join_segment": f"""SELECT {_PAYMENT}, segment
FROM eligible JOIN (SELECT DISTINCT * FROM segments) USING (company_id)""",
        "join_segment_driven": f"""SELECT {_PAYMENT}, segment
FROM segments JOIN eligible USING (company_id) WHERE segment = 'target'""",
        "join_recent_semi": f"""SELECT {_ROLLED} FROM rollup
WHERE company_id IN (SELECT company_id FROM recent)""",
        "recency": "SELECT * FROM recency",
        "recency_all": "SELECT * FROM recency_all",
        "monthly_activity": _months("monthly"),
        "monthly_activity_all": _months("monthly_all"),
        "monthly_activity_by_type": _months("monthly_type").replace(
            "'target'", "payment_type, 'target'"
        ),
        "activity_rollup": f"SELECT {_ROLLED} FROM rollup",
        "activity_rollup_all": f"SELECT {_ROLLED} FROM rollup_all",
        "frequency": f"SELECT {_ROLLED}, {_RATES} FROM freq",
        "frequency_all": f"SELECT {_ROLLED}, {_RATES} FROM freq_all",
        "type_totals": """SELECT company_id, payment_type, CAST(amount AS DOUBLE) AS total_payments,
  n AS total_payment_count FROM totals_type""",
        "schedule_distincts": f"SELECT company_id, schedule_type, {_DISTINCTS} FROM distincts",
        "schedule_shares": f"""SELECT company_id, schedule_type, {_DISTINCTS},
  round(schedule_share, 6) AS schedule_share, round(payment_share, 6) AS payment_share
FROM sched_shares""",
        "schedule_pivot": "SELECT company_id, "
        + _each("count_{c}", ("schedule_oneoff", "schedule_recurring", "payment_oneoff", "payment_recurring"))
        + ", "
        + _each(
            "round({c}, 6) AS {c}",
            [f"{k}_share_{t}" for k in ("schedule", "payment") for t in ("oneoff", "recurring")],
        )
        + " FROM sched_pivot",
        "type_shares": """SELECT company_id, payment_type, round(share, 6) AS payment_type_share
FROM mix""",
        "type_share_pivot": "SELECT company_id, "
        + _each("round(share_{c}, 6) AS share_{c}", [n for _, n in _TYPES])
        + " FROM mix_pivot",
        "type_amount_pivot": "SELECT company_id, "
        + ", ".join(
            f"CAST(max(CASE WHEN payment_type = '{t}' THEN amount ELSE 0 END) AS DOUBLE) AS amount_{n}"
            for t, n in _TYPES
        )
        + """, CAST(sum(amount) AS DOUBLE) AS sum_total_payments,
  CAST(sum(n) AS BIGINT) AS sum_total_payment_count
FROM totals_type WHERE company_id IN (SELECT company_id FROM recent) GROUP BY company_id""",
        "rfm_features_12m": f"SELECT company_id, {_DAYS_AND_RATIOS} FROM features",
        "rfm_features_all": f"SELECT company_id, {_DAYS_AND_RATIOS} FROM features_all",
        "rfm_features_all_totals": f"""SELECT company_id, {_DAYS_AND_RATIOS},
  CAST(first_month AS VARCHAR) AS first_active_month,
  CAST(last_month AS VARCHAR) AS last_active_month,
  CAST(total_payments AS DOUBLE) AS total_payments, total_payment_count FROM features_all""",
        "rfm_with_type_shares": f"SELECT company_id, {_DAYS_AND_RATIOS}, "
        + _each("round(share_{c}, 6) AS share_{c}", [n for _, n in _TYPES])
        + " FROM features_all JOIN mix_pivot USING (company_id)",
        "feature_head": f"""SELECT company_id, {_DAYS_AND_RATIOS} FROM features
ORDER BY company_id LIMIT 5""",
        "feature_shape": """SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols FROM features""",
        "profile_raw": _profile("features"),
        "transformed": f"SELECT company_id, {_ROUNDED} FROM logged",
        "transformed_linear": f"""SELECT l.company_id,
  round(390 - f.days_since_first_tx, 6) AS days_since_first_tx, {_each("round(l.{c}, 6) AS {c}", FEATURES[1:])}
FROM logged l JOIN features f USING (company_id)""",
        "profile_transformed": _profile("logged"),
        "scaled": f"SELECT company_id, {_ROUNDED} FROM points",
        "profile_scaled": _profile("points"),
        "medoid_init": """SELECT position, medoid AS company_id, round(total, 6) AS total_distance
FROM starts WHERE position <= 4""",
        "distance_pairs": """SELECT company_id, medoid AS candidate_id, round(d, 6) AS distance
FROM start_pairs""",
        "medoid_assign": """SELECT company_id, best[2] AS cluster, round(best[3], 6) AS distance
FROM start_labels""",
        "medoid_inertia": "SELECT round(sum(best[3]), 6) AS loss FROM start_labels",
        "elbow": """SELECT k, round(sum(nearest) / 1e9, 6) AS loss FROM (
  SELECT k, o, min(q) AS nearest FROM dist JOIN alt ON h = medoid
  WHERE step = (SELECT max(step) FROM alt) GROUP BY k, o) GROUP BY k""",
        "pam4": """SELECT best[2] AS cluster, count(*) AS n_companies, round(sum(best[3]), 6) AS loss,
  any_value(medoid) AS medoid_id
FROM pam_labels JOIN pam ON slot = best[2] WHERE step = (SELECT max(step) FROM pam)
GROUP BY best[2]""",
        "company_clusters": f"""SELECT company_id, {_ROUNDED}, best[2] AS cluster
FROM points JOIN pam_labels USING (company_id)""",
    }
    # the same results by way of stored months
    final |= {f"{name}_from_months": final[name] for name in ("recency", "frequency", "type_totals")}
    return {name: _with(text) for name, text in final.items()}
