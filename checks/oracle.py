"""DuckDB twins of the registered queries, written the long way round.

They follow the plain reading of each query (explode first, windows over raw rows, joins for the
first-touch date) so that they share no shortcut with the Spark operators they check.
"""

from __future__ import annotations

KEY = "first_touch_date, traffic_source, os, country"
BUCKETS = ("d_1", "d_3", "d_5", "d_7")

# name, event, key, reading
METRICS = (
    ("session_user_engagement_sec", "view", "k", "sec"),
    ("session_claimed_ad_rewards", "click", "k", "event_value"),
    ("session_challenged_friend", "purchase", "k", "event_value"),
    ("session_was_challenged", "signup", "k", "event_value"),
    ("session_played_levels", "purchase", "value", "score_value"),
    ("session_completed_levels", "view", "screen", "screen_class"),
    ("session_retried_levels", "click", "screen", "screen_class"),
    ("session_failed_levels", "error", "screen", "screen_class"),
    ("session_reseted_levels", "signup", "screen", "screen_class"),
    ("session_ended_levels", "purchase", "screen", "screen_class"),
    ("session_used_extra_steps", "error", "k", "event_value"),
    ("session_no_more_extra_steps", "view", "k", "event_value"),
)
NAMES = tuple(m[0] for m in METRICS)
FEATURES = tuple(f"{n}_{b}" for b in BUCKETS for n in NAMES) + (
    "avg_session_duration_sec", "avg_sessions_count")

CANON = """
canon AS (
  SELECT e.event_id, CAST(e.user_id AS VARCHAR) AS user_pseudo_id,
         epoch_us(e.ts) AS event_timestamp, CAST(e.ts AS DATE) AS activity_day,
         e.event_type AS event_name, c.c_mktsegment AS traffic_source,
         CASE WHEN e.user_id % 2 = 0 THEN 'IOS' ELSE 'ANDROID' END AS os,
         n.n_name AS country, e.value,
         CAST(regexp_extract(e.props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
activity AS (SELECT DISTINCT user_pseudo_id, activity_day FROM canon),
touch AS (SELECT user_pseudo_id, MIN(activity_day) AS first_touch_date FROM activity GROUP BY 1),
rows_ AS (
  SELECT event_id, user_pseudo_id, event_timestamp, activity_day, event_name, traffic_source, os,
         country, 'k' AS event_key, CAST(NULL AS VARCHAR) AS screen_class, k AS event_value,
         CAST(NULL AS DOUBLE) AS score_value FROM canon
  UNION ALL
  SELECT event_id, user_pseudo_id, event_timestamp, activity_day, event_name, traffic_source, os,
         country, 'value', NULL, NULL, value FROM canon
  UNION ALL
  SELECT event_id, user_pseudo_id, event_timestamp, activity_day, event_name, traffic_source, os,
         country, 'screen', event_name, NULL, NULL FROM canon)
"""

SESSIONS = CANON + """,
lagged AS (
  SELECT r.*, t.first_touch_date,
         LAG(event_timestamp) OVER (PARTITION BY r.user_pseudo_id ORDER BY event_timestamp) AS prev
  FROM rows_ r LEFT JOIN touch t USING (user_pseudo_id)),
flagged AS (
  SELECT *, CASE WHEN prev IS NULL OR (event_timestamp - prev) // 60000000 >= 90
                 THEN 1 ELSE 0 END AS fresh FROM lagged),
sess AS (
  SELECT *, CAST(SUM(fresh) OVER (PARTITION BY user_pseudo_id ORDER BY event_timestamp) AS BIGINT)
              AS user_session_id FROM flagged)
"""

DURATIONS = SESSIONS + f""",
durations AS (
  SELECT {KEY}, user_pseudo_id, user_session_id,
         CAST((MAX(event_timestamp) - MIN(event_timestamp)) // 1000000 AS BIGINT)
           AS session_duration_sec,
         MAX(user_session_id) AS n_sessions
  FROM sess WHERE year(first_touch_date) = 2024 GROUP BY ALL),
session_tab AS (
  SELECT {KEY}, AVG(session_duration_sec) AS avg_session_duration_sec,
         AVG(n_sessions) AS avg_sessions_count,
         COUNT(*) / CAST(COUNT(DISTINCT user_pseudo_id) AS DOUBLE) AS avg_sessions_per_user
  FROM durations GROUP BY ALL)
"""


def _reading(reading: str) -> str:
    if reading == "sec":
        return "SUM(CAST(event_value AS DECIMAL(38, 9)))"
    return f"COUNT({reading})"


_FINE = ",\n         ".join(
    f"CASE WHEN event_name = '{event}' AND event_key = '{key}' THEN {_reading(reading)} END "
    f"AS {name}" for name, event, key, reading in METRICS)
_FLAGS = ", ".join(
    f"CAST(CASE WHEN day_after_launch > {lo} AND day_after_launch <= {hi} THEN 1 ELSE 0 END "
    f"AS BIGINT) AS d_{hi}" for lo, hi in ((-1, 1), (1, 3), (3, 5), (5, 7)))


def _events_cte(corrected: bool = False) -> str:
    total = []
    for name in NAMES:
        source = name
        if name == "session_played_levels" and not corrected:
            source = "session_completed_levels"
        if name == "session_user_engagement_sec":
            total.append(f"CAST(SUM({source}) AS DOUBLE) / 1000 AS {name}")
        else:
            total.append(f"CAST(SUM({source}) AS BIGINT) AS {name}")
    return SESSIONS + f""",
fine AS (
  SELECT user_pseudo_id, user_session_id, {KEY}, activity_day, event_name, event_key,
         {_FINE}
  FROM sess
  WHERE event_name IN ('click', 'purchase', 'error', 'signup', 'view')
    AND event_key IN ('k', 'screen', 'value') AND year(first_touch_date) = 2024
  GROUP BY user_pseudo_id, user_session_id, {KEY}, activity_day, event_name, event_key),
coarse AS (
  SELECT user_pseudo_id, user_session_id, {KEY}, activity_day,
         {", ".join(total)}
  FROM fine GROUP BY user_pseudo_id, user_session_id, {KEY}, activity_day),
act AS (
  SELECT a.user_pseudo_id, t.first_touch_date, a.activity_day,
         CAST(1 + (a.activity_day - t.first_touch_date) AS BIGINT) AS day_after_launch
  FROM activity a LEFT JOIN touch t USING (user_pseudo_id)),
event_tab AS (
  SELECT c.user_pseudo_id, c.first_touch_date, c.activity_day, day_after_launch, {_FLAGS},
         user_session_id, traffic_source, os, country, {", ".join(NAMES)}
  FROM act RIGHT JOIN coarse c USING (user_pseudo_id, first_touch_date, activity_day)
  WHERE traffic_source IS NOT NULL AND os IS NOT NULL AND country IS NOT NULL),
cat AS (
  SELECT *, CASE WHEN d_1 = 1 THEN 'd_1' WHEN d_3 = 1 THEN 'd_3' WHEN d_5 = 1 THEN 'd_5'
                 WHEN d_7 = 1 THEN 'd_7' END AS d_cat FROM event_tab)
"""


EVENTS = _events_cte()


def _pivot_columns() -> str:
    out = []
    for b in BUCKETS:
        for n in NAMES:
            kind = "DOUBLE" if n == "session_user_engagement_sec" else "BIGINT"
            value = f"SUM(CASE WHEN d_cat = '{b}' THEN {n} END)"
            if kind == "DOUBLE":
                # Three decimals are exact: rounding removes the order of floating additions.
                out.append(f"ROUND({value}, 3) AS {n}_{b}")
            else:
                out.append(f"CAST({value} AS BIGINT) AS {n}_{b}")
    return ", ".join(out)


PIVOT = f"pivot_tab AS (SELECT {KEY}, {_pivot_columns()} FROM cat GROUP BY {KEY})"


def _revenue_cte(partition: str, base: str = SESSIONS) -> str:
    return base + f""",
earning AS (
  SELECT *, (event_timestamp - LAG(event_timestamp) OVER (
              PARTITION BY {partition}
              ORDER BY event_timestamp, user_pseudo_id, traffic_source, os, country))
            // 1000000 AS gap_sec
  FROM sess WHERE screen_class IN ('click', 'view', 'purchase')),
daily AS (
  SELECT user_pseudo_id, {KEY}, activity_day,
         CAST(SUM(gap_sec) AS BIGINT) AS earned_sec
  FROM earning WHERE year(first_touch_date) = 2024
    AND traffic_source IS NOT NULL AND os IS NOT NULL AND country IS NOT NULL
  GROUP BY ALL),
revenue_tab AS (
  SELECT user_pseudo_id, {KEY}, activity_day,
         CAST(1 + (activity_day - first_touch_date) AS BIGINT) AS day_after_launch,
         CAST(CASE WHEN 1 + (activity_day - first_touch_date) <= 12 THEN 1 ELSE 0 END AS BIGINT)
           AS before_avg_lifetime, earned_sec
  FROM daily),
ltv_tab AS (
  SELECT {KEY},
         CASE WHEN before_avg_lifetime = 1
              THEN CAST(SUM(earned_sec) AS DOUBLE) * CAST('0.0001' AS DOUBLE) ELSE 0e0 END
           AS cohort_ltv_avg_lifetime
  FROM revenue_tab GROUP BY {KEY}, before_avg_lifetime),
ltv_best AS (
  SELECT {KEY}, cohort_ltv_avg_lifetime FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY}
                                 ORDER BY cohort_ltv_avg_lifetime DESC NULLS LAST) AS row_
    FROM ltv_tab) WHERE row_ = 1)
"""


PER_USER = "user_pseudo_id, user_session_id"
POOLED = "user_session_id"
REVENUE_COLUMNS = f"""user_pseudo_id, {KEY}, activity_day, day_after_launch, before_avg_lifetime,
  CAST(earned_sec AS DOUBLE) * CAST('0.0001' AS DOUBLE) AS ad_revenue_at_day"""


def _wide_cte(partition: str = PER_USER) -> str:
    filled = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in FEATURES)
    durations = DURATIONS[len(SESSIONS):]
    return _revenue_cte(partition, EVENTS) + durations + f""",
{PIVOT},
wide AS (
  SELECT first_touch_date, traffic_source, os,
         CASE WHEN country = '' THEN 'Rest of the World' ELSE country END AS country,
         COALESCE(cohort_ltv_avg_lifetime, 0) AS cohort_ltv_avg_lifetime, {filled}
  FROM ltv_best LEFT JOIN pivot_tab USING ({KEY}) LEFT JOIN session_tab USING ({KEY}))
"""


WIDE = _wide_cte()


def split_part(buckets: int, seed: int = 143) -> str:
    text = (f"concat_ws('|', '{seed}', CAST(first_touch_date AS VARCHAR), traffic_source, os, "
            "country)")
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {buckets})"


REQUESTS = """
requests AS (
  SELECT 'r' || CAST(c_custkey AS VARCHAR) AS request_id,
         CAST(CAST('2024-01-01' AS DATE) + CAST(c_custkey % 4 AS INTEGER) AS DATE)
           AS first_touch_date,
         c_mktsegment AS traffic_source,
         CASE WHEN c_custkey % 2 = 0 THEN 'IOS' ELSE 'ANDROID' END AS os, n_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def _unpivoted() -> str:
    parts = []
    for c in FEATURES[:-2]:
        value = f"trunc({c})" if "engagement" in c else c
        parts.append(
            f"SELECT {KEY}, cohort_ltv_avg_lifetime, avg_session_duration_sec, avg_sessions_count, "
            f"'{c}' AS session_metric, CAST({value} AS DOUBLE) AS session_metric_value FROM wide")
    return " UNION ALL ".join(parts)


def _norm() -> str:
    total = " + ".join(f"CAST({c} AS DOUBLE) * {c}" for c in FEATURES[:-2])
    scaled = ", ".join(
        f"ROUND(CASE WHEN n2 = 0 THEN 0 ELSE {c} / sqrt(n2) END, 9) AS {c}" for c in FEATURES[:-2])
    return f"SELECT {KEY}, {scaled} FROM (SELECT *, {total} AS n2 FROM wide)"


def _minmax() -> str:
    scaled = ", ".join(
        f"ROUND(CASE WHEN MAX({c}) OVER () = MIN({c}) OVER () THEN 0.5 ELSE "
        f"({c} - MIN({c}) OVER ()) / CAST(MAX({c}) OVER () - MIN({c}) OVER () AS DOUBLE) END, 9) "
        f"AS {c}" for c in FEATURES)
    return f"SELECT {KEY}, {scaled} FROM wide"


def _profile() -> str:
    cols = ["traffic_source", "os", "country", "cohort_ltv_avg_lifetime", *FEATURES]
    out = []
    for c in cols:
        bad = f"{c} IS NULL"
        if c in ("traffic_source", "os", "country"):
            bad += f" OR contains({c}, 'None') OR contains({c}, 'NULL') OR {c} = ''"
        elif c.startswith("avg") or c.startswith("cohort") or "engagement" in c:
            bad += f" OR isnan({c})"
        out.append(f"COUNT(*) FILTER (WHERE {bad}) AS {c}")
    unfilled = ", ".join(["traffic_source", "os", "country", "cohort_ltv_avg_lifetime", *FEATURES])
    return (f", raw_wide AS (SELECT {unfilled} FROM ltv_best LEFT JOIN pivot_tab USING ({KEY}) "
            f"LEFT JOIN session_tab USING ({KEY})) SELECT {', '.join(out)} FROM raw_wide")


def _path(regs: str, mixes: str) -> str:
    """Mean RMSE over ten folds (scores) of a linear model on one feature with both penalties."""
    return f"""{WIDE},
            xy AS (SELECT CAST(cohort_ltv_avg_lifetime AS DOUBLE) AS y,
                          CAST(avg_session_duration_sec AS DOUBLE) AS x,
                          {split_part(10, 511)} AS fold
                   FROM wide WHERE {split_part(100)} < 80),
            held AS (SELECT DISTINCT fold AS own FROM xy),
            regs AS (SELECT CAST(unnest({regs}) AS DOUBLE) AS reg_param),
            mixes AS (SELECT CAST(unnest({mixes}) AS DOUBLE) AS mix),
            sums AS (SELECT own, AVG(x) AS mx, AVG(y) AS my, covar_pop(y, x) AS c, var_pop(x) AS v,
                            stddev_pop(y) AS s FROM xy, held WHERE fold <> own GROUP BY own),
            fits AS (SELECT own, reg_param, mix, mx, my,
                            sign(c) * greatest(abs(c) - mix * reg_param, 0) / (v + (1 - mix) * reg_param / s)
                              AS slope
                     FROM sums, regs, mixes),
            errors AS (SELECT own, reg_param, mix, sqrt(AVG((y - my - slope * (x - mx))
                                                            * (y - my - slope * (x - mx)))) AS e
                       FROM fits JOIN xy ON fold = own GROUP BY own, reg_param, mix),
            scores AS (SELECT reg_param, mix, ROUND(AVG(e), 6) AS rmse FROM errors GROUP BY reg_param, mix)"""


WIDE_COLUMNS = f"{KEY}, cohort_ltv_avg_lifetime, {', '.join(FEATURES)}"
# The filtered queries ask for one cohort of the tables: a date, a source, an OS and a country.
ONE_COHORT = ("first_touch_date = DATE '2024-01-01' AND traffic_source = 'FURNITURE' "
              "AND os = 'IOS' AND country = 'NATION_20'")
MESSAGES = """
messages AS (
  SELECT c_custkey AS offset_, 'r' || CAST(c_custkey AS VARCHAR) AS id,
         CASE c_custkey % 5 WHEN 0 THEN 'request' WHEN 1 THEN 'predict' WHEN 2 THEN 'done'
              WHEN 3 THEN 'request' ELSE 'rejected' END AS kind,
         CASE WHEN c_custkey % 5 = 2 THEN c_acctbal END AS predicted_ltv
  FROM customer)
"""

EVENT_COLUMNS = f"""user_pseudo_id, first_touch_date, activity_day, day_after_launch, d_1, d_3, d_5,
  d_7, user_session_id, traffic_source, os, country, {', '.join(NAMES)}"""
DONE = ", ".join(NAMES)


def statements() -> dict[str, str]:
    ltv = f"SELECT {KEY}, cohort_ltv_avg_lifetime FROM"
    session_columns = f"{KEY}, avg_session_duration_sec, avg_sessions_count, avg_sessions_per_user"
    by_day = ("SELECT activity_day, COUNT(*) AS n_events, "
              "COUNT(DISTINCT user_pseudo_id) AS n_users FROM canon")
    latest = f"""WITH {MESSAGES}
            SELECT id, MAX(CASE WHEN kind = 'predict' THEN id END) AS bucket_folder_id,
                   MAX_BY(predicted_ltv, offset_) FILTER (WHERE kind = 'done') AS prediction
            FROM (SELECT * FROM messages WHERE kind IN ('predict', 'done')
                  UNION ALL
                  SELECT offset_ + 1000000000, id, 'done', predicted_ltv + 1
                  FROM messages WHERE kind = 'done'
                  UNION ALL
                  SELECT offset_ + 1000000000, id, 'done', 0.25 FROM messages
                  WHERE kind = 'predict')
            GROUP BY id"""
    return {
        "active_days": f"WITH {CANON} SELECT user_pseudo_id, activity_day FROM activity",
        "first_touch": f"WITH {CANON} SELECT user_pseudo_id, first_touch_date FROM touch",
        "daily_activity": f"""WITH {EVENTS}
            SELECT user_pseudo_id, first_touch_date, activity_day, day_after_launch, {_FLAGS}
            FROM act""",
        "explode_params": f"""WITH {CANON}
            SELECT user_pseudo_id, event_timestamp, event_name, traffic_source, os, country,
                   event_key, screen_class, event_value, score_value
            FROM rows_ WHERE event_name IN ('view', 'purchase') AND event_key IN ('k', 'screen')""",
        "sessionize": f"""WITH {SESSIONS}
            SELECT DISTINCT user_pseudo_id, event_timestamp, event_name, traffic_source, os,
                   country, first_touch_date, user_session_id
            FROM sess WHERE year(first_touch_date) = 2024""",
        "session_durations": f"""WITH {DURATIONS}
            SELECT {KEY}, user_pseudo_id, user_session_id, session_duration_sec, n_sessions
            FROM durations""",
        "session_cohort_metrics": f"WITH {DURATIONS} SELECT {session_columns} FROM session_tab",
        "event_session_metrics": f"WITH {EVENTS} SELECT {EVENT_COLUMNS} FROM event_tab",
        "event_session_metrics_corrected":
            f"WITH {_events_cte(True)} SELECT {EVENT_COLUMNS} FROM event_tab",
        "bucket_presence": f"""WITH {EVENTS}
            SELECT {KEY}, {', '.join(f'CAST(SUM({b}) AS BIGINT) AS {b}' for b in BUCKETS)}
            FROM event_tab GROUP BY {KEY}""",
        "bucket_completion": f"""WITH {EVENTS},
            buckets AS (SELECT unnest(['d_1', 'd_3', 'd_5', 'd_7']) AS d_cat),
            grid AS (SELECT * FROM (SELECT DISTINCT {KEY} FROM cat), buckets),
            gone AS (SELECT * FROM grid ANTI JOIN cat USING ({KEY}, d_cat))
            SELECT {KEY}, user_pseudo_id, user_session_id, activity_day, d_cat, {DONE} FROM cat
            UNION ALL
            SELECT {KEY}, NULL, NULL, NULL, d_cat, {', '.join('NULL' for _ in NAMES)} FROM gone""",
        "event_bucket_pivot": f"WITH {EVENTS}, {PIVOT} SELECT * FROM pivot_tab",
        "revenue_daily": f"WITH {_revenue_cte(PER_USER)} SELECT {REVENUE_COLUMNS} FROM revenue_tab",
        "revenue_daily_pooled":
            f"WITH {_revenue_cte(POOLED)} SELECT {REVENUE_COLUMNS} FROM revenue_tab",
        "cohort_ltv": f"WITH {_revenue_cte(PER_USER)} {ltv} ltv_tab",
        "cohort_ltv_pooled": f"WITH {_revenue_cte(POOLED)} {ltv} ltv_tab",
        "cohort_ltv_dedup": f"WITH {_revenue_cte(PER_USER)} {ltv} ltv_best",
        "features_wide": f"WITH {WIDE} SELECT {WIDE_COLUMNS} FROM wide",
        "features_wide_joined": f"WITH {WIDE} SELECT {WIDE_COLUMNS} FROM wide",
        "features_from_timeline": f"WITH {WIDE} SELECT {WIDE_COLUMNS} FROM wide",
        "features_wide_pooled": f"WITH {_wide_cte(POOLED)} SELECT {WIDE_COLUMNS} FROM wide",
        "features_long": f"WITH {WIDE} {_unpivoted()}",
        "cohort_filtered_session":
            f"WITH {DURATIONS} SELECT {session_columns} FROM session_tab WHERE {ONE_COHORT}",
        "cohort_filtered_event":
            f"WITH {EVENTS} SELECT {EVENT_COLUMNS} FROM event_tab WHERE {ONE_COHORT}",
        "cohort_filtered_ltv":
            f"WITH {_revenue_cte(PER_USER)} {ltv} ltv_tab WHERE {ONE_COHORT}",
        "duplicate_cohorts": f"""WITH {_revenue_cte(PER_USER)}
            SELECT {KEY}, COUNT(*) AS "count" FROM ltv_tab GROUP BY {KEY} HAVING COUNT(*) > 1""",
        "dq_profile": f"WITH {WIDE}{_profile()}",
        "dq_profile_of_table": f"WITH {WIDE}{_profile()}",
        "features_from_buckets": f"WITH {WIDE} SELECT {WIDE_COLUMNS} FROM wide",
        "features_incremental": f"WITH {WIDE} SELECT {WIDE_COLUMNS} FROM wide",
        "sql_session":
            f"WITH {DURATIONS} SELECT {session_columns} FROM session_tab WHERE {ONE_COHORT}",
        "sql_event": f"WITH {EVENTS} SELECT {EVENT_COLUMNS} FROM event_tab WHERE {ONE_COHORT}",
        "sql_ltv": f"WITH {_revenue_cte(PER_USER)} {ltv} ltv_tab WHERE {ONE_COHORT}",
        "counts_by_traffic_source":
            f'WITH {WIDE} SELECT traffic_source, COUNT(*) AS "count" FROM wide GROUP BY 1',
        "counts_by_os": f'WITH {WIDE} SELECT os, COUNT(*) AS "count" FROM wide GROUP BY 1',
        "preview": f"WITH {WIDE} SELECT {WIDE_COLUMNS} FROM wide ORDER BY {KEY} LIMIT 3",
        "minmax_scaled": f"WITH {WIDE} {_minmax()}",
        "l2_normalized": f"WITH {WIDE} {_norm()}",
        "train_test_split": f"""WITH {WIDE} SELECT {KEY}, cohort_ltv_avg_lifetime,
            CASE WHEN {split_part(100)} < 80 THEN 'train' ELSE 'test' END AS part FROM wide""",
        "baseline_rmse": f"""WITH {WIDE},
            parts AS (SELECT cohort_ltv_avg_lifetime AS y, {split_part(100)} < 80 AS train
                      FROM wide),
            mean_ AS (SELECT AVG(y) AS m FROM parts WHERE train)
            SELECT ROUND(ANY_VALUE(m), 9) AS target_avg,
                   ROUND(sqrt(AVG((y - m) * (y - m))), 9) AS rmse, COUNT(*) AS test_rows
            FROM parts, mean_ WHERE NOT train""",
        "cv_folds": f"""WITH {WIDE},
            folds AS (SELECT CAST({split_part(10, 511)} AS INTEGER) AS fold FROM wide
                      WHERE {split_part(100)} < 80)
            SELECT fold, COUNT(*) AS scored_rows,
                   CAST((SELECT COUNT(*) FROM folds) - COUNT(*) AS BIGINT) AS train_rows
            FROM folds GROUP BY fold""",
        "ridge_one_feature": f"""WITH {WIDE},
            xy AS (SELECT CAST(cohort_ltv_avg_lifetime AS DOUBLE) AS y,
                          CAST(avg_session_duration_sec AS DOUBLE) AS x
                   FROM wide WHERE {split_part(100)} < 80),
            m AS (SELECT AVG(x) AS mx, AVG(y) AS my, covar_pop(y, x)
                         / (var_pop(x) + 2.0 / stddev_pop(y)) AS slope FROM xy)
            SELECT ROUND(slope, 6) AS slope, ROUND(my - slope * mx, 6) AS intercept FROM m""",
        "ridge_path": f"""WITH {_path("[0.1, 0.5, 1.0, 5.0, 10.0]", "[0.0]")}
            SELECT reg_param, rmse FROM scores""",
        "elastic_path": f"""WITH {_path("[0.1, 0.5, 1.0, 5.0, 10.0]", "[0.1, 0.3, 0.5, 0.7, 0.9, 1.0]")}
            SELECT reg_param, mix, rmse FROM scores""",
        "path_neighbours": f"""WITH {_path("[0.1, 0.5, 1.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0]", "[0.0]")},
            numbered AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY reg_param) - 1 AS INTEGER) AS grid_index,
                                reg_param, rmse FROM scores),
            best AS (SELECT MIN_BY(grid_index, rmse) AS top_index FROM numbered)
            SELECT grid_index, reg_param, rmse FROM numbered, best WHERE abs(grid_index - top_index) <= 1""",
        "stored_ridge": f"""WITH {WIDE},
            xy AS (SELECT CAST(cohort_ltv_avg_lifetime AS DOUBLE) AS y,
                          CAST(avg_session_duration_sec AS DOUBLE) AS x
                   FROM wide WHERE {split_part(100)} < 80),
            m AS (SELECT AVG(x) AS mx, AVG(y) AS my, covar_pop(y, x)
                         / (var_pop(x) + 2.0 / stddev_pop(y)) AS slope FROM xy)
            SELECT ROUND(slope, 6) AS slope, ROUND(my - slope * mx, 6) AS intercept FROM m""",
        "tree_stump": f"""WITH {WIDE},
            xy AS (SELECT CAST(cohort_ltv_avg_lifetime AS DOUBLE) AS y,
                          CAST(session_claimed_ad_rewards_d_1 AS DOUBLE) AS x
                   FROM wide WHERE {split_part(100)} < 80),
            cuts AS (SELECT (x + next_x) / 2 AS threshold FROM (
                       SELECT x, LEAD(x) OVER (ORDER BY x) AS next_x FROM (SELECT DISTINCT x FROM xy))
                     WHERE next_x IS NOT NULL),
            sides AS (SELECT threshold, AVG(y) FILTER (WHERE x <= threshold) AS low_mean,
                             AVG(y) FILTER (WHERE x > threshold) AS high_mean,
                             var_pop(y) FILTER (WHERE x <= threshold) * COUNT(*) FILTER (WHERE x <= threshold)
                             + var_pop(y) FILTER (WHERE x > threshold) * COUNT(*) FILTER (WHERE x > threshold)
                               AS rest
                      FROM xy, cuts GROUP BY threshold)
            SELECT threshold, ROUND(low_mean, 6) AS low_mean, ROUND(high_mean, 6) AS high_mean
            FROM sides ORDER BY rest, threshold LIMIT 1""",
        "pca_two": f"""WITH {WIDE},
            m AS (SELECT var_samp(CAST(avg_session_duration_sec AS DOUBLE)) AS a,
                         var_samp(CAST(avg_sessions_count AS DOUBLE)) AS c,
                         covar_samp(CAST(avg_session_duration_sec AS DOUBLE), CAST(avg_sessions_count AS DOUBLE)) AS b
                  FROM wide),
            e AS (SELECT a + c AS total, sqrt((a - c) * (a - c) + 4 * b * b) AS gap FROM m)
            SELECT ROUND((total + gap) / (2 * total), 9) AS "first",
                   ROUND((total - gap) / (2 * total), 9) AS "second" FROM e""",
        "three_part_split": f"""WITH {WIDE} SELECT {KEY}, cohort_ltv_avg_lifetime,
            CASE WHEN {split_part(100)} < 70 THEN 'train' WHEN {split_part(100)} < 85 THEN 'test'
                 ELSE 'holdout' END AS part FROM wide""",
        "stored_features": f"WITH {WIDE} SELECT {WIDE_COLUMNS} FROM wide",
        "stored_features_long": f"WITH {WIDE} {_unpivoted()}",
        "event_shards": f"WITH {CANON} {by_day} GROUP BY activity_day",
        "event_shards_pruned": f"""WITH {CANON} {by_day}
            WHERE activity_day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'
            GROUP BY activity_day""",
        "suffix_shards": f"""WITH {CANON} {by_day}
            WHERE activity_day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'
            GROUP BY activity_day""",
        "cohort_event_ordered": f"WITH {EVENTS} SELECT {EVENT_COLUMNS} FROM event_tab",
        "cohort_ltv_ordered": f"WITH {_revenue_cte(PER_USER)} {ltv} ltv_tab",
        "table_roundtrip": f"WITH {DURATIONS} SELECT {session_columns} FROM session_tab",
        "request_features": f"""WITH {WIDE}, {REQUESTS}
            SELECT request_id, first_touch_date, traffic_source, os, country,
                   wide.country IS NOT NULL AS known,
                   wide.cohort_ltv_avg_lifetime, avg_session_duration_sec
            FROM requests LEFT JOIN wide USING ({KEY})""",
        "csv_roundtrip": f"""WITH {WIDE}
            SELECT 'r0' AS data_id, ROUND(AVG(cohort_ltv_avg_lifetime), 6) AS predicted_ltv FROM wide""",
        "request_folder_session":
            f"WITH {DURATIONS} SELECT {session_columns} FROM session_tab WHERE {ONE_COHORT}",
        "request_folder_event":
            f"WITH {EVENTS} SELECT {EVENT_COLUMNS} FROM event_tab WHERE {ONE_COHORT}",
        "request_folder_ltv":
            f"WITH {_revenue_cte(PER_USER)} {ltv} ltv_tab WHERE {ONE_COHORT}",
        "prepared_requests": f"""WITH {WIDE}, {REQUESTS}
            SELECT request_id, first_touch_date, traffic_source, os, country,
                   wide.country IS NOT NULL AS known,
                   wide.cohort_ltv_avg_lifetime, avg_session_duration_sec
            FROM requests LEFT JOIN wide USING ({KEY})""",
        "prepared_answers": f"""WITH {WIDE}, {REQUESTS}
            SELECT request_id, wide.country IS NOT NULL AS answered
            FROM requests LEFT JOIN wide USING ({KEY})""",
        "requests_answered": f"""WITH {WIDE}, {REQUESTS}
            SELECT request_id, wide.country IS NOT NULL AS answered
            FROM requests LEFT JOIN wide USING ({KEY})""",
        "stream_answers": f"""WITH {WIDE}, {REQUESTS}
            SELECT request_id AS id, request_id AS bucket_folder_id,
                   wide.country IS NOT NULL AS answered
            FROM requests LEFT JOIN wide USING ({KEY})""",
        "stream_ingest": f"""WITH {REQUESTS},
            hashed AS (SELECT *, md5('app_request/0/' || substr(request_id, 2)) AS h FROM requests),
            named AS (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4)
                      || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS ident, * FROM hashed)
            SELECT ident AS request_id, first_touch_date, traffic_source, os, country,
                   '{{"input_data":{{"country":"' || country || '","date":"'
                   || strftime(first_touch_date, '%Y-%m-%d') || '","os":"' || os
                   || '","traffic_source":"' || traffic_source || '"}},"request_id":"' || ident || '"}}'
                   AS value
            FROM named""",
        "stream_route": f"""WITH {MESSAGES}
            SELECT kind, CASE WHEN kind <> 'rejected' THEN id END AS id, predicted_ltv
            FROM messages""",
        "stream_latest_state": latest,
        "stream_lookup": f"""SELECT id, bucket_folder_id, ROUND(prediction, 2) AS prediction
            FROM ({latest}) WHERE id = 'r2'""",
    }
