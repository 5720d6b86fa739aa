"""SQL twins of the registered queries, for an independent engine to run.

They state each result in the plainest way, without regard to scale. Doubles
are rounded as the queries round them; adding 0.0 turns a negative zero into
zero.
"""

from __future__ import annotations

from rarebird.settings import COUNTRY_NAMES, EXPERIMENTS, LABEL_NAMES, SECTOR_NAMES

YEARLY = """
yearly AS (
  SELECT o_custkey AS emis_id, CAST(year(o_orderdate) AS INT) AS year,
         count(*) AS n_orders, sum(o_totalprice) AS revenue,
         avg(o_totalprice) AS order_avg, min(o_totalprice) AS order_min,
         max(o_totalprice) AS order_max, stddev_samp(o_totalprice) AS order_sd,
         avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS pending_avg,
         max(CASE WHEN o_totalprice > 480000 THEN o_totalprice END) AS large_max,
         max(CASE WHEN o_totalprice > 498000 THEN o_totalprice END) AS near_null_max
  FROM orders GROUP BY o_custkey, CAST(year(o_orderdate) AS INT)),
company_years AS (
  SELECT a.emis_id, c.c_name AS company, c.c_mktsegment AS industry,
         CAST(c.c_nationkey % 4 AS INT) AS country,
         CAST(1 + a.emis_id % 6 AS INT) AS sector_1, a.year,
         a.n_orders, a.revenue, a.order_avg, a.order_min, a.order_max,
         CASE WHEN a.n_orders >= 2 THEN a.order_sd END AS order_sd,
         a.pending_avg, a.large_max, a.near_null_max, c.c_acctbal AS acctbal,
         a.revenue > 400000 AS is_large,
         CASE WHEN coalesce(b.n_orders, 0) >= 5 THEN 1 ELSE 0 END AS main_label
  FROM yearly a JOIN customer c ON c.c_custkey = a.emis_id
  LEFT JOIN yearly b ON b.emis_id = a.emis_id AND b.year = a.year + 1
  WHERE a.year <= 1999),
divided AS (
  SELECT *, CASE WHEN substr(md5(concat(length(CAST(emis_id AS VARCHAR)), ':', emis_id, length(CAST(year AS VARCHAR)), ':', year)), 1, 8) < 'cccccccc'
                 THEN 'train' ELSE 'test' END AS split
  FROM company_years)"""

ALL_FEATURES = [
    "country", "sector_1", "year", "n_orders", "revenue", "order_avg", "order_min",
    "order_max", "order_sd", "pending_avg", "large_max", "near_null_max", "acctbal", "is_large",
]
KEPT_FEATURES = [f for f in ALL_FEATURES if f != "near_null_max"]

SCORED = """
scored AS (
  SELECT split, main_label AS label, experiment,
         CASE WHEN score >= cut THEN 1 ELSE 0 END AS prediction, score
  FROM (
    SELECT split, main_label, 's1_mixed' AS experiment, CAST(3 AS DOUBLE) AS cut,
           round(CAST(0.7 AS DOUBLE) * n_orders + revenue / CAST(1000000 AS DOUBLE)
                 + coalesce(pending_avg, 0) / CAST(1000000 AS DOUBLE), 2) AS score FROM divided
    UNION ALL
    SELECT split, main_label, 's2_count', 4, CAST(n_orders AS DOUBLE) FROM divided
    UNION ALL
    SELECT split, main_label, 's3_revenue', 9, round(revenue / CAST(100000 AS DOUBLE), 1)
    FROM divided
    UNION ALL
    SELECT split, main_label, 's4_balance', 80, round(acctbal / CAST(100 AS DOUBLE), 0)
    FROM divided))"""

CONFUSION = """
confusion AS (
  SELECT experiment, split,
         count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
  FROM scored GROUP BY experiment, split)"""

# Ratios in double, 0 where the denominator is 0.
METRICS = """
metrics AS (
  SELECT *,
    coalesce((f1_positive * (tp + fn) + f1_negative * (tn + fp)) / nullif(n, 0), 0) AS f1_weighted
  FROM (
    SELECT experiment, split, tp + tn + fp + fn AS n, tp, tn, fp, fn,
      coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy,
      coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
      coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
      coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fn + fp, 0), 0) AS f1_positive,
      coalesce(CAST(2 * tn AS DOUBLE) / nullif(2 * tn + fn + fp, 0), 0) AS f1_negative,
      coalesce(CAST(5 * tp AS DOUBLE) / nullif(5 * tp + 4 * fn + fp, 0), 0) AS f2,
      coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
               / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)
        AS mcc,
      coalesce(CAST(tp - fp - 10 * fn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0) AS utility
    FROM confusion))"""

AREAS = """
curve AS (
  SELECT *, sum(p) OVER down AS tp, sum(n) OVER down AS fp,
         sum(p) OVER whole AS all_p, sum(n) OVER whole AS all_n
  FROM (SELECT experiment, split, score, CAST(sum(label) AS DOUBLE) AS p,
               CAST(sum(1 - label) AS DOUBLE) AS n
        FROM scored GROUP BY experiment, split, score)
  WINDOW down AS (PARTITION BY experiment, split ORDER BY score DESC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         whole AS (PARTITION BY experiment, split)),
steps AS (
  SELECT *, tp / (tp + fp) AS prec,
         coalesce((tp - p) / nullif(tp - p + fp - n, 0), tp / (tp + fp)) AS prec_before
  FROM curve),
areas AS (
  SELECT experiment, split,
         coalesce(sum(n * (tp + tp - p)) / nullif(2 * max(all_p) * max(all_n), 0), 0) AS auc_roc,
         coalesce(sum(p * (prec + prec_before)) / nullif(2 * max(all_p), 0), 0) AS auc_pr,
         coalesce(sum(p * prec) / nullif(max(all_p), 0), 0) AS average_precision
  FROM steps GROUP BY experiment, split),
evaluated AS (SELECT * FROM metrics JOIN areas USING (experiment, split))"""

METRIC_NAMES = [
    "accuracy", "precision", "recall", "f1_weighted", "f1_positive", "f2", "mcc", "utility",
]
AREA_NAMES = ["auc_roc", "auc_pr", "average_precision"]


def r6(expression: str) -> str:
    return f"round({expression}, 6) + CAST(0 AS DOUBLE)"


def with_(select: str, *parts: str) -> str:
    return "WITH " + ",".join((YEARLY, *parts)) + "\n" + select


def evaluated(select: str, *parts: str) -> str:
    return with_(select, SCORED, CONFUSION, METRICS, AREAS, *parts)


def as_double(feature: str) -> str:
    return f"CAST({feature} AS DOUBLE)"


def code_case(names: dict[int, str], code: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items())
    return f"CASE {code} {whens} ELSE CAST({code} AS VARCHAR) END"


def distribution(column: str, names: dict[int, str]) -> str:
    return with_(
        f"""SELECT {column} AS key, {code_case(names, column)} AS name, count(*) AS n,
                   {r6("count(*) * 100.0 / sum(count(*)) OVER ()")} AS pct
            FROM company_years GROUP BY {column}"""
    )


COVERAGE = ",\ncoverage AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) AS n, count({f}) AS non_null, "
    f"count({f}) / CAST(count(*) AS DOUBLE) AS share FROM divided WHERE split = 'train'"
    for f in ALL_FEATURES
) + ")"
COVERAGE = COVERAGE.lstrip(",\n")

MEDIANS = "medians AS (SELECT " + ", ".join(
    f"median({as_double(f)}) AS {f}" for f in KEPT_FEATURES
) + " FROM divided WHERE split = 'train')"

FILLED = "filled AS (SELECT d.emis_id, d.year AS key_year, d.split, d.main_label, " + ", ".join(
    f"coalesce({as_double('d.' + f)}, m.{f}) AS {f}" for f in KEPT_FEATURES
) + " FROM divided d, medians m)"

STATS = "stats AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg({f}) AS mean, stddev_samp({f}) AS deviation "
    "FROM filled WHERE split = 'train'"
    for f in KEPT_FEATURES
) + ")"

COLUMN_TYPES = {
    "emis_id": "bigint", "company": "string", "industry": "string", "country": "int",
    "sector_1": "int", "year": "int", "n_orders": "bigint", "revenue": "double",
    "order_avg": "double", "order_min": "double", "order_max": "double", "order_sd": "double",
    "pending_avg": "double", "large_max": "double", "near_null_max": "double",
    "acctbal": "double", "is_large": "boolean", "main_label": "int",
}


def column_role(name: str) -> str:
    if name == "main_label":
        return "label"
    return "id" if name in ("emis_id", "company", "industry") else "feature"


RESULT_NAMES = {
    "Acc": "accuracy", "AUC": "auc_roc", "PRAUC": "auc_pr", "Prec": "precision",
    "Recall": "recall", "F1": "f1_weighted", "F2": "f2", "MCC": "mcc", "Utility": "utility",
}
FORMULAS = ["s1_mixed", "s2_count", "s3_revenue", "s4_balance"]


def picked(value: str, split: str) -> str:
    return f"max(CASE WHEN split = '{split}' THEN {value} END)"


def r4(expression: str) -> str:
    return f"round({expression}, 4) + CAST(0 AS DOUBLE)"


def result_roundtrip() -> str:
    numbered = [(f, e, i) for i, (f, e) in enumerate(zip(FORMULAS, EXPERIMENTS), 1)]

    def case(shown: list[tuple[str, str]]) -> str:
        return "CASE experiment " + " ".join(f"WHEN '{f}' THEN {v}" for f, v in shown) + " END"

    columns = [
        case([(f, f"'{e.name}'") for f, e, _ in numbered]) + ' AS "Experiment"',
        *[
            f'{r4(picked(m, side.lower()))} AS "{side}{short}"'
            for short, m in RESULT_NAMES.items()
            for side in ("Train", "Test")
        ],
        *[f'{picked(c, "test")} AS "Test_{c.upper()}"' for c in ("tp", "tn", "fp", "fn")],
        case([(f, f"CAST({i} AS DOUBLE)") for f, _, i in numbered]) + ' AS "TrainTime_s"',
        case([(f, f"'{e.short_name}'") for f, e, _ in numbered]) + " AS short_name",
        f"CAST({sum(i for _, _, i in numbered)} AS DOUBLE) AS total_seconds",
        case([(f, f"CAST({i} AS DOUBLE)") for f, _, i in numbered]) + " AS recorded",
    ]
    return evaluated(f"SELECT {', '.join(columns)} FROM evaluated GROUP BY experiment")


def ablation(left: str, right: str) -> str:
    def row(metric: str) -> str:
        return (
            f"SELECT '{metric}' AS metric, {r6('l.' + metric)} AS \"left\", "
            f"{r6('r.' + metric)} AS \"right\", {r6(f'r.{metric} - l.{metric}')} AS delta "
            f"FROM evaluated l, evaluated r WHERE l.experiment = '{left}' "
            f"AND r.experiment = '{right}' AND l.split = 'test' AND r.split = 'test'"
        )

    return evaluated(" UNION ALL ".join(row(m) for m in METRIC_NAMES + AREA_NAMES))


def experiment_check(rows: str) -> str:
    """Rows and positives of every experiment and split, all checks met."""
    return with_(
        " UNION ALL ".join(
            f"SELECT '{e.name}' AS experiment, split, count(*) AS n, "
            "CAST(sum(main_label) AS BIGINT) AS positives, TRUE AS areas_in_range, "
            f"TRUE AS pca_agrees FROM {rows} GROUP BY split"
            for e in EXPERIMENTS
        )
    )


def cells(select: str) -> str:
    """One SELECT per confusion cell, ``{c}`` standing for the cell."""
    return with_(
        " UNION ALL ".join(select.format(c=c) for c in ("tp", "tn", "fp", "fn")), SCORED, CONFUSION
    )


def split_comparison() -> str:
    """The scored rows get both policies in place of experiments, test rows only."""
    policies = """
policies AS (
  SELECT *, 'random' AS policy, split = 'test' AS taken FROM divided
  UNION ALL SELECT *, 'temporal', year > 1997 FROM divided),
scored AS (
  SELECT experiment, split, label, CASE WHEN score >= 3 THEN 1 ELSE 0 END AS prediction, score
  FROM (SELECT policy AS experiment, 'test' AS split, main_label AS label,
               round(CAST(0.7 AS DOUBLE) * n_orders + revenue / CAST(1000000 AS DOUBLE)
                     + coalesce(pending_avg, 0) / CAST(1000000 AS DOUBLE), 2) AS score
        FROM policies WHERE taken))"""
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r6(f'CAST(l.{m} AS DOUBLE)')} AS \"left\", "
        f"{r6(f'CAST(r.{m} AS DOUBLE)')} AS \"right\", "
        f"{r6(f'CAST(r.{m} AS DOUBLE) - l.{m}')} AS delta "
        "FROM evaluated l, evaluated r "
        "WHERE l.experiment = 'random' AND r.experiment = 'temporal'"
        for m in [*METRIC_NAMES, *AREA_NAMES, "fp", "fn"]
    )
    return with_(rows, policies, CONFUSION, METRICS, AREAS)


ENTRIES = """
WITH entries AS (
  SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS position,
         CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""

K = "json_extract_string(props, '$.k')"

ORACLE: dict[str, str] = {
    "scan_counts": with_(
        """SELECT count(*) AS total, count(*) FILTER (WHERE split = 'train') AS train,
                  count(*) FILTER (WHERE split = 'test') AS test FROM divided"""
    ),
    "column_roles": with_(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{t}' AS type, '{column_role(c)}' AS role, "
            f"count({c}) AS non_null FROM company_years"
            for c, t in COLUMN_TYPES.items()
        )
    ),
    "result_roundtrip": result_roundtrip(),
    "clean_features": with_(
        "SELECT "
        + ", ".join(f"{r6(as_double(f))} AS {f}" for f in [*ALL_FEATURES, "main_label"])
        + " FROM company_years"
    ),
    "lenient_cast": f"""
        SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS from_type,
               TRY_CAST(props AS DOUBLE) AS from_props, TRY_CAST({K} AS DOUBLE) AS from_k,
               CASE WHEN event_type <> 'error' THEN CAST({K} AS DOUBLE) END AS from_mixed,
               CAST({K} AS DOUBLE) / 10 AS from_exponent, CAST(NULL AS DOUBLE) AS from_suffix
        FROM events""",
    "invalid_rows": with_(
        "SELECT emis_id, key_year, n_missing, n_missing = 0 AS kept FROM (SELECT emis_id, "
        "year AS key_year, CAST("
        + " + ".join(f"CASE WHEN {f} IS NULL THEN 1 ELSE 0 END" for f in ALL_FEATURES)
        + " AS INT) AS n_missing FROM company_years)"
    ),
    "complete_rows": with_(
        "SELECT emis_id, year AS key_year FROM company_years "
        "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ALL_FEATURES)
    ),
    "hash_split": with_("SELECT emis_id, year, split FROM divided"),
    "temporal_split": with_(
        """SELECT emis_id, CASE WHEN year <= 1997 THEN 'train' ELSE 'test' END AS split,
                  n_orders, main_label FROM company_years"""
    ),
    "split_profile": with_(
        """SELECT year, CASE WHEN year <= 1997 THEN 'train' ELSE 'test' END AS split,
                  count(*) AS n FROM company_years GROUP BY year"""
    ),
    "hash_sample": with_(
        """SELECT emis_id, year, main_label FROM company_years
           WHERE substr(md5(concat('sample-', length(CAST(emis_id AS VARCHAR)), ':', emis_id, length(CAST(year AS VARCHAR)), ':', year)), 1, 8) < '19999999'"""
    ),
    "laid_sample": with_(
        """SELECT emis_id, year, main_label FROM company_years
           WHERE substr(md5(concat('sample-', length(CAST(emis_id AS VARCHAR)), ':', emis_id, length(CAST(year AS VARCHAR)), ':', year)), 1, 8) < '19999999'"""
    ),
    "laid_side": with_(
        """SELECT emis_id, 'test' AS split, n_orders, main_label FROM company_years WHERE year > 1997
           AND substr(md5(concat('sample-', length(CAST(emis_id AS VARCHAR)), ':', emis_id, length(CAST(year AS VARCHAR)), ':', year)), 1, 8) < '80000000'"""
    ),
    "exact_sample": with_(
        """SELECT emis_id, year, main_label FROM company_years
           ORDER BY md5(concat('sample-', length(CAST(emis_id AS VARCHAR)), ':', emis_id, length(CAST(year AS VARCHAR)), ':', year))
           LIMIT 500"""
    ),
    "label_distribution": distribution("main_label", LABEL_NAMES),
    "country_distribution": distribution("country", COUNTRY_NAMES),
    "sector_distribution": distribution("sector_1", SECTOR_NAMES),
    "profile_all": with_(
        " UNION ALL ".join(
            f"SELECT '{c}' AS dimension, {c} AS key, count(*) AS n, "
            f"{r6('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct "
            f"FROM company_years GROUP BY {c}"
            for c in ("main_label", "country", "sector_1")
        )
    ),
    "feature_coverage": with_(
        f"SELECT feature, n, non_null, {r6('share')} AS share FROM coverage", COVERAGE
    ),
    "valid_features": with_(
        f"SELECT feature, {r6('share')} AS share FROM coverage WHERE share >= 0.05", COVERAGE
    ),
    "study_tally": with_(
        " UNION ALL ".join(
            f"""SELECT {name} AS feature, split, CAST(main_label AS INTEGER) AS label, count(*) AS n,
                       count({value}) AS non_null FROM divided GROUP BY split, main_label"""
            for name, value in [("NULL", "1"), *((f"'{f}'", as_double(f)) for f in ALL_FEATURES)]
        )
    ),
    "class_weights": with_(
        " UNION ALL ".join(
            f"""SELECT {k} AS label, count(*) FILTER (WHERE main_label = {k}) AS n,
                {r6(f"count(*) / (CAST(2 AS DOUBLE) * greatest(1, count(*) "
                    f"FILTER (WHERE main_label = {k})))")} AS weight
                FROM divided WHERE split = 'train'"""
            for k in (0, 1)
        )
    ),
    "weighted_rows": with_(
        f"""SELECT emis_id, year, main_label,
                   {r6("count(*) OVER () / (CAST(2 AS DOUBLE) * count(*) "
                       "OVER (PARTITION BY main_label))")} AS "classWeight"
            FROM divided WHERE split = 'train'"""
    ),
    "feature_medians": with_(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, {r6(f)} AS median FROM medians" for f in KEPT_FEATURES
        ),
        MEDIANS,
    ),
    "feature_medians_check": with_(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, count({f}) AS n, TRUE AS within "
            "FROM divided WHERE split = 'train'"
            for f in KEPT_FEATURES
        )
    ),
    "sketch_medians_check": with_(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, count({f}) AS n, TRUE AS within FROM divided WHERE year <= 1997" for f in ALL_FEATURES
        )
    ),
    "dropped_features": with_(
        f"""SELECT feature, n, non_null, {r6("(n - non_null) / CAST(n AS DOUBLE)")} AS missing_share
            FROM coverage WHERE share < 0.05""",
        COVERAGE,
    ),
    "impute_ml_check": with_(
        " UNION ALL ".join(
            f"SELECT emis_id, year AS key_year, '{f}' AS feature, {f} IS NULL AS was_missing, "
            f"{r6(as_double(f))} AS present_value, TRUE AS filled FROM divided"
            for f in KEPT_FEATURES
        )
    ),
    "impute_exact": with_(
        "SELECT emis_id, key_year, split, CAST(main_label AS DOUBLE) AS main_label, "
        + ", ".join(f"{r6(f)} AS {f}" for f in KEPT_FEATURES)
        + " FROM filled",
        MEDIANS,
        FILLED,
    ),
    "assemble": with_(
        " UNION ALL ".join(
            f"SELECT emis_id, key_year, {i} AS position, {r6(f)} AS value FROM filled"
            for i, f in enumerate(KEPT_FEATURES)
        ),
        MEDIANS,
        FILLED,
    ),
    "scaler_stats": with_(
        f"SELECT feature, {r4('mean')} AS mean, {r4('deviation')} AS deviation FROM stats",
        MEDIANS,
        FILLED,
        STATS,
    ),
    "standardise": with_(
        "SELECT f.emis_id, f.key_year, "
        + ", ".join(
            r6(
                f"(f.{c} - (SELECT mean FROM stats WHERE feature = '{c}'))"
                f" / (SELECT deviation FROM stats WHERE feature = '{c}')"
            )
            + f" AS {c}"
            for c in KEPT_FEATURES
        )
        + " FROM filled f",
        MEDIANS,
        FILLED,
        STATS,
    ),
    "scale_ml": ENTRIES
    + f""", stats AS (SELECT position, avg(value) AS mean, stddev_samp(value) AS deviation
                      FROM entries GROUP BY position)
        SELECT vec_id, position, {r6("(value - mean) / deviation")} AS value
        FROM entries JOIN stats USING (position)""",
    "pca_check": ENTRIES
    + f""", varied AS (SELECT position, count(*) AS n, var_samp(value) > 0 AS varies
                       FROM entries GROUP BY position)
        SELECT count(*) AS components, max(n) AS n,
               {r6("CAST(count(*) FILTER (WHERE varies) AS DOUBLE)")} AS variance,
               TRUE AS explained, TRUE AS orthonormal, TRUE AS descending FROM varied""",
    "forest_check": with_(
        """SELECT emis_id, year AS key_year, split, main_label AS label,
                  TRUE AS score_bounded, TRUE AS class_follows FROM divided"""
    ),
    "experiment_check": experiment_check("divided"),
    "temporal_experiment_check": experiment_check(
        """(SELECT main_label, CASE WHEN year <= 1997 THEN 'train' ELSE 'test' END AS split
            FROM company_years)"""
    ),
    "covariance_pairs": ENTRIES
    + f"""SELECT format('v{{:02d}}', a.position) AS feature_a,
                 format('v{{:02d}}', b.position) AS feature_b,
                 {r6("covar_samp(a.value, b.value)")} AS covariance
          FROM entries a JOIN entries b ON a.vec_id = b.vec_id AND a.position <= b.position
          GROUP BY a.position, b.position""",
    "confusion_matrix": with_("SELECT * FROM confusion", SCORED, CONFUSION),
    "metrics_all": with_(
        "SELECT experiment, split, n, tp, tn, fp, fn, "
        + ", ".join(f"{r6(m)} AS {m}" for m in METRIC_NAMES)
        + " FROM metrics",
        SCORED,
        CONFUSION,
        METRICS,
    ),
    **{
        a: evaluated(f"SELECT experiment, split, {r6(a)} AS value FROM evaluated")
        for a in AREA_NAMES
    },
    "utility_baseline": with_(
        f"""SELECT experiment, split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
                   {r6("-10 * CAST(sum(label) AS DOUBLE) / count(*)")} AS utility
            FROM scored GROUP BY experiment, split""",
        SCORED,
    ),
    "pr_lift": evaluated(
        f"""SELECT experiment, split, {r6("auc_pr")} AS auc_pr, {r6("share")} AS prevalence,
                   {r6("coalesce(auc_pr / nullif(share, 0), 0)")} AS lift
            FROM (SELECT *, (tp + fn) / CAST(n AS DOUBLE) AS share FROM evaluated)"""
    ),
    "experiment_table": evaluated(
        "SELECT experiment, "
        + ", ".join(
            f"{r4(picked(m, s))} AS {s}_{m}"
            for m in METRIC_NAMES + AREA_NAMES
            for s in ("train", "test")
        )
        + ", "
        + ", ".join(f"{picked(c, 'test')} AS {c}" for c in ("tp", "tn", "fp", "fn"))
        + " FROM evaluated GROUP BY experiment"
    ),
    "ablation_delta": ablation("s1_mixed", "s2_count"),
    "ablation_delta_pca": ablation("s2_count", "s4_balance"),
    "ablation_delta_pca_plain": ablation("s1_mixed", "s3_revenue"),
    "metric_extremes": evaluated(
        " UNION ALL ".join(
            f"SELECT split, '{m}' AS metric, {r6(f'min({m})')} AS lowest, "
            f"{r6(f'max({m})')} AS highest FROM evaluated GROUP BY split"
            for m in METRIC_NAMES + AREA_NAMES
        )
    ),
    "headline": evaluated(
        f"""SELECT {r6("max(recall)")} AS best_recall, {r6("max(mcc)")} AS best_mcc,
                   {r6("max(auc_pr)")} AS best_auc_pr,
                   {r6("max(auc_pr) FILTER (WHERE experiment = 's2_count') "
                       "- max(auc_pr) FILTER (WHERE experiment = 's4_balance')")} AS pca_drop
            FROM evaluated WHERE split = 'test'"""
    ),
    "confusion_change": cells(
        "SELECT '{c}' AS cell, l.{c} AS \"left\", r.{c} AS \"right\", r.{c} - l.{c} AS change "
        "FROM confusion l, confusion r WHERE l.experiment = 's1_mixed' "
        "AND r.experiment = 's2_count' AND l.split = 'test' AND r.split = 'test'"
    ),
    "split_comparison": split_comparison(),
    "metrics_long": evaluated(
        " UNION ALL ".join(
            f"SELECT experiment, split, '{m}' AS metric, {r6(m)} AS value FROM evaluated"
            for m in METRIC_NAMES + AREA_NAMES
        )
    ),
    "confusion_shares": cells(
        "SELECT experiment, split, '{c}' AS cell, {c} AS n, "
        "round({c} * CAST(100 AS DOUBLE) / (tp + tn + fp + fn), 6) AS pct FROM confusion"
    ),
    "best_experiment": evaluated(
        f"""SELECT experiment, split, 'auc_pr' AS metric, {r6("auc_pr")} AS value
            FROM evaluated WHERE split = 'test' ORDER BY auc_pr DESC, experiment LIMIT 1"""
    ),
}
