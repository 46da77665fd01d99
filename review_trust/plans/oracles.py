"""SQL that gives the same results as the queries, over the same whole tables."""

from __future__ import annotations

from review_trust.config import ENCODER_DIM, FOREST_SAMPLE, FOREST_TREES, REPORT_ROWS, SEED, TEST_RATIO, TOP_K
from review_trust.plans.queries import CORE
from review_trust.schema import FEATURES

# Extra rounds change nothing once the core is reached.
CORE_ROUNDS = 10

# All Unicode white space; RE2's own class is ASCII only.
_SPACE = r"\s\p{Z}\x{85}\x0B"

_REVIEWS = """
reviews AS MATERIALIZED (
  SELECT concat('U', o_custkey) AS user_id,
         concat('I', l_partkey) AS parent_asin,
         CAST(epoch_ms(l_shipdate) + l_linenumber * 3600000 + l_partkey % 1000 AS BIGINT) AS timestamp,
         CAST(1.0 + CAST(l_quantity AS INTEGER) % 5 AS DOUBLE) AS rating,
         l_returnflag <> 'R' AS verified_purchase,
         CAST(nullif(l_linenumber, 7) - 1 AS BIGINT) AS helpful_vote,
         p_name AS title,
         CASE WHEN l_linenumber <> 5 THEN d.text END AS text,
         embedding
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN documents d ON d.doc_id = (l_orderkey * 7 + l_partkey) % (SELECT count(*) FROM documents)
  JOIN embeddings ON vec_id = (l_partkey * 31 + o_custkey) % (SELECT count(*) FROM embeddings)
)"""

_HIST = "hist AS (SELECT user_id, rating, count(*) AS n FROM reviews GROUP BY ALL)"

_ENTROPY = """
entropy AS (
  SELECT user_id, sum(-p * log2(p)) + 0.0 AS rating_entropy
  FROM (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM hist)
  GROUP BY user_id
)"""

_FEATURES = """
bursts AS (
  SELECT user_id, max(n) AS burstiness
  FROM (SELECT user_id, timestamp // 86400000 AS day, count(*) AS n FROM reviews GROUP BY ALL)
  GROUP BY user_id
),
features AS MATERIALIZED (
  SELECT user_id,
         count(*) AS review_count,
         avg(rating) AS avg_rating,
         coalesce(stddev_samp(rating), 0) AS rating_std,
         count(*) FILTER (rating IN (1, 5)) / count(*) AS pct_extreme,
         sum(verified_purchase::INTEGER) / count(*) AS pct_verified,
         coalesce(avg(helpful_vote), 0) AS avg_helpful,
         CAST((max(timestamp) - min(timestamp)) // 86400000 AS BIGINT) AS activity_span_days,
         avg(length(coalesce(text, ''))) AS avg_text_length,
         count(DISTINCT parent_asin) / count(*) AS unique_items_ratio,
         any_value(burstiness) AS burstiness,
         any_value(rating_entropy) AS rating_entropy
  FROM reviews JOIN bursts USING (user_id) JOIN entropy USING (user_id)
  GROUP BY user_id
)"""

_TRUST = """
trust AS MATERIALIZED (
  SELECT user_id, round((rating_entropy - low) / (high - low), 9) AS trust_score
  FROM entropy, (SELECT min(rating_entropy) AS low, max(rating_entropy) AS high FROM entropy)
)"""

_SPLIT = f"""
cutoff AS (
  SELECT timestamp AS cut
  FROM (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM reviews)
  WHERE i = floor((n - 1) * {1.0 - TEST_RATIO} + 0.5)
),
train AS MATERIALIZED (SELECT * FROM reviews WHERE timestamp <= (SELECT cut FROM cutoff)),
test AS MATERIALIZED (SELECT * FROM reviews WHERE timestamp > (SELECT cut FROM cutoff)),
truth AS (SELECT DISTINCT user_id, parent_asin FROM test),
evaluable AS (SELECT DISTINCT user_id FROM test WHERE user_id IN (SELECT user_id FROM train))"""


def _item_trust(source: str) -> str:
    return f"""
item_trust AS (
  SELECT parent_asin, avg(coalesce(trust_score, 1.0)) AS item_trust_factor
  FROM {source} LEFT JOIN trust USING (user_id) GROUP BY parent_asin
)"""


def _profile(name: str, key: str) -> str:
    return f"""
{name}_long AS (
  SELECT {key}, pos - 1 AS pos, avg(v) AS value
  FROM (SELECT {key}, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM reviews)
  GROUP BY ALL
),
{name} AS MATERIALIZED (SELECT {key}, list(value ORDER BY pos) AS p FROM {name}_long GROUP BY {key})"""


_PROFILES = _profile("up", "user_id") + "," + _profile("ip", "parent_asin")


def _ranking(name: str, users: str, factor: str, k: int) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT user_id, rank, parent_asin, score
  FROM (
    SELECT user_id, parent_asin, score,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, parent_asin) AS INTEGER) AS rank
    FROM (
      SELECT user_id, parent_asin,
             round(greatest(coalesce(list_cosine_similarity(up.p, ip.p), 0), 0) * {factor}, 9) AS score
      FROM {users} JOIN up USING (user_id) CROSS JOIN ip LEFT JOIN item_trust USING (parent_asin)
    )
  )
  WHERE rank <= {k}
)"""


_FACTOR = "coalesce(item_trust_factor, 1.0)"
_DEEP = max(TOP_K)
_BASE = [_REVIEWS, _HIST, _ENTROPY, _TRUST, _SPLIT, _item_trust("train"), _PROFILES]
_BASELINE = _ranking("base", "evaluable", "1.0", _DEEP)
_TRUSTED = _ranking("trusted", "evaluable", _FACTOR, _DEEP)

_KS = ", ".join(f"({k})" for k in TOP_K)


def _scored(name: str, ranking: str) -> str:
    """Precision and nDCG per evaluated user and k."""
    return f"""
{name} AS (
  SELECT user_id, CAST(k AS INTEGER) AS k, hits / k AS precision,
         dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 1000) r(i) WHERE i <= least(n_relevant, k)) AS ndcg
  FROM (
    SELECT user_id, k, any_value(n_relevant) AS n_relevant,
           count(t.parent_asin) FILTER (rank <= k) AS hits,
           sum(CASE WHEN t.parent_asin IS NOT NULL AND rank <= k THEN 1.0 / log2(rank + 1) ELSE 0.0 END) AS dcg
    FROM {ranking} r
    JOIN (SELECT user_id, count(*) AS n_relevant FROM truth GROUP BY user_id) USING (user_id)
    LEFT JOIN truth t USING (user_id, parent_asin)
    CROSS JOIN (VALUES {_KS}) ks(k)
    GROUP BY user_id, k
  )
)"""


def _means(name: str, scored: str) -> str:
    return f"""
{name} AS (
  SELECT 'Precision' AS metric, k, avg(precision) AS value FROM {scored} GROUP BY k
  UNION ALL SELECT 'nDCG', k, avg(ndcg) FROM {scored} GROUP BY k
)"""


_COMPARED = [
    _scored("scored_base", "base"),
    _scored("scored_trust", "trusted"),
    _means("means_base", "scored_base"),
    _means("means_trust", "scored_trust"),
    "both_means AS (SELECT metric, k, b.value AS baseline, t.value AS trust, "
    "round(t.value - b.value, 12) AS delta FROM means_base b JOIN means_trust t USING (metric, k))",
]

_SHIFTS = f"""
shifts AS (
  SELECT parent_asin, avg(b.rank - 1 - coalesce(t.rank - 1, length)) AS shift
  FROM base b
  JOIN (SELECT user_id, count(*) AS length FROM base GROUP BY user_id) USING (user_id)
  LEFT JOIN trusted t USING (user_id, parent_asin)
  WHERE user_id IN (SELECT user_id FROM trusted)
  GROUP BY parent_asin
)"""


def _core() -> list[str]:
    steps = [_REVIEWS, "c0 AS MATERIALIZED (SELECT user_id, parent_asin FROM reviews)"]
    for i in range(CORE_ROUNDS):
        for source, target, key in ((f"c{i}", f"u{i}", "user_id"), (f"u{i}", f"c{i + 1}", "parent_asin")):
            strong = f"SELECT {key} FROM {source} GROUP BY {key} HAVING count(*) >= {CORE}"
            steps.append(f"{target} AS MATERIALIZED (SELECT * FROM {source} WHERE {key} IN ({strong}))")
    steps.append(f"core AS MATERIALIZED (SELECT * FROM c{CORE_ROUNDS})")
    return steps


def _clean(column: str) -> str:
    text = f"regexp_replace(coalesce({column}, ''), '<[^>]*>', ' ', 'g')"
    text = f"regexp_replace({text}, 'https?://[^{_SPACE}]+|www\\.[^{_SPACE}]+', ' ', 'g')"
    return _squeeze(text)


def _squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{_SPACE}]+', ' ', 'g'))"


def _cleaned(source: str) -> str:
    """The source with title and text cleaned and review_text added."""
    return f"""
cleaned AS (
  SELECT *, {_squeeze("concat(title, ' ', text)")} AS review_text
  FROM (SELECT * REPLACE ({_clean('title')} AS title, {_clean('text')} AS text) FROM {source})
)"""


# Levels of a tree of FOREST_SAMPLE users, and of any of more than half as many.
_LEVELS = (FOREST_SAMPLE - 1).bit_length()


def _forest() -> list[str]:
    """The isolation forest over ``features``, level by level, up to every user's trust."""
    low, high = (f"[{', '.join(f'{f}(x[{i + 1}])' for i in range(len(FEATURES)))}]" for f in ("min", "max"))
    digest = f"md5(concat({SEED}, ':', tree, ':', node))"
    steps = [
        f"points AS MATERIALIZED (SELECT user_id, [{', '.join(f'round(CAST({c} AS DOUBLE), 9)' for c in FEATURES)}] AS x "
        "FROM features)",
        f"g0 AS MATERIALIZED (SELECT tree, x, 1 AS node, false AS leaf FROM (SELECT tree, x, row_number() OVER (PARTITION BY "
        f"tree ORDER BY left(md5(concat({SEED}, ':', tree, ':', user_id)), 16), user_id) AS place "
        f"FROM points CROSS JOIN range({FOREST_TREES}) r(tree)) WHERE place <= {FOREST_SAMPLE})",
        f"w0 AS (SELECT user_id, x, tree, 1 AS node FROM points CROSS JOIN range({FOREST_TREES}) r(tree))",
    ]
    for d in range(_LEVELS):
        steps += [
            f"r{d} AS (SELECT tree, node, {low} AS low, {high} AS high, {digest} AS h FROM g{d} WHERE NOT leaf GROUP BY tree, node)",
            f"v{d} AS (SELECT *, list_filter(range(1, {len(FEATURES) + 1}), lambda i: high[i] > low[i]) AS varying FROM r{d})",
            f"f{d} AS (SELECT *, varying[1 + (CAST('0x' || left(h, 8) AS BIGINT) * len(varying) >> 32)] AS feature, "
            f"CAST('0x' || h[9:21] AS BIGINT) / 4503599627370496.0 AS part FROM v{d} WHERE len(varying) > 0)",
            f"s{d} AS MATERIALIZED (SELECT tree, node, feature, CASE WHEN low[feature] + part * (high[feature] - low[feature]) "
            f">= high[feature] THEN low[feature] ELSE low[feature] + part * (high[feature] - low[feature]) END AS threshold "
            f"FROM f{d})",
        ]
        step = f"CASE WHEN feature IS NULL THEN node WHEN x[feature] > threshold THEN 2 * node + 1 ELSE 2 * node END AS node"
        split = f"LEFT JOIN s{d} USING (tree, node)"
        steps += [
            f"g{d + 1} AS MATERIALIZED (SELECT tree, x, {step}, feature IS NULL AS leaf FROM g{d} {split})",
            f"w{d + 1} AS MATERIALIZED (SELECT user_id, x, tree, {step} FROM w{d} {split})",
        ]
    # Expected length of an unsuccessful search among n points.
    mean = "CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0) + 0.5772156649015329) - 2 * ({n} - 1.0) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    steps += [
        f"leaves AS (SELECT tree, node, count(*) AS n FROM g{_LEVELS} GROUP BY tree, node)",
        f"paths AS (SELECT user_id, avg(length(bin(node)) - 1 + {mean.format(n='n')}) AS path "
        f"FROM w{_LEVELS} JOIN leaves USING (tree, node) GROUP BY user_id)",
        f"sampled AS (SELECT least(count(*), {FOREST_SAMPLE}) AS n FROM points)",
        f"anomaly AS (SELECT user_id, -pow(2, -path / {mean.format(n='n')}) AS score FROM paths, sampled)",
        "trust AS MATERIALIZED (SELECT user_id, coalesce((score - min(score) OVER ()) / "
        "nullif(max(score) OVER () - min(score) OVER (), 0), 1.0) AS trust_score FROM anomaly)",
    ]
    return steps


def _whole_run() -> list[str]:
    """All steps of the run on the core reviews, with the default encoder, up to both rankings' metrics."""
    steps = [cte.replace("reviews AS", "all_reviews AS").replace("FROM reviews", "FROM all_reviews") for cte in _core()]
    steps += [
        "core_rows AS MATERIALIZED (SELECT row_number() OVER () AS rid, * EXCLUDE (embedding) "
        "FROM all_reviews WHERE user_id IN (SELECT user_id FROM core) AND parent_asin IN (SELECT parent_asin FROM core))",
        "reviews AS (SELECT * EXCLUDE (rid, title) FROM core_rows)",
        _cleaned("core_rows"),
        _embedded("vectors", "cleaned", "rid", "review_text"),
    ]
    for name, key in (("up", "user_id"), ("ip", "parent_asin")):
        steps += [
            f"{name}_n AS (SELECT {key}, count(*) AS n FROM core_rows GROUP BY {key})",
            f"{name}_sum AS (SELECT {key}, pos, sum(value) AS s FROM vectors JOIN core_rows USING (rid) GROUP BY ALL)",
            f"{name} AS MATERIALIZED (SELECT a.{key}, list(coalesce(s, 0) / n ORDER BY i) AS p FROM {name}_n a "
            f"CROSS JOIN range({ENCODER_DIM}) r(i) LEFT JOIN {name}_sum b ON a.{key} = b.{key} AND b.pos = i "
            f"GROUP BY a.{key})",
        ]
    steps += [_HIST, _ENTROPY, _FEATURES, *_forest(), _SPLIT, _item_trust("train"), _BASELINE, _TRUSTED]
    return [*steps, *_COMPARED]


def _embedded(name: str, source: str, key: str, text: str) -> str:
    """The default encoder's vectors, element by element without zeros."""
    return f"""
{name}_words AS (
  SELECT {key}, unnest(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM {source}
),
{name}_counts AS (
  SELECT {key}, CAST(CAST('0x' || left(md5(word), 8) AS BIGINT) % {ENCODER_DIM} AS BIGINT) AS pos, count(*) AS n
  FROM {name}_words WHERE word <> '' GROUP BY 1, 2
),
{name} AS MATERIALIZED (
  SELECT {key}, pos, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS value FROM {name}_counts
)"""


def _sql(ctes: list[str], select: str) -> str:
    return f"WITH {','.join(ctes)}\n{select}" if ctes else select


def _r6(column: str) -> str:
    return f"round({column}, 6) + 0.0 AS {column}"


_LONG_FEATURES = {"review_count", "activity_span_days", "burstiness"}


def oracles() -> dict[str, str]:
    core = _core()
    feature_ctes = [_REVIEWS, _HIST, _ENTROPY, _FEATURES]
    both = [*_BASE, _BASELINE, _TRUSTED]
    base_scored = [*_BASE, _BASELINE, _scored("scored", "base")]
    scores = "SELECT user_id, rank, parent_asin, round(score, 6) + 0.0 AS score FROM"
    compared = (
        f"SELECT metric, k, {_r6('baseline')}, {_r6('trust')}, {_r6('delta')}, "
        "CASE WHEN both_means.delta > 0 THEN '↑' WHEN both_means.delta < 0 THEN '↓' ELSE '=' END AS arrow "
        "FROM both_means"
    )
    pages = """
pages_reviews AS (
  SELECT page_id,
         CASE WHEN page_id % 10 <> 3 THEN concat('Visit ', url, ' now <b>bold</b>') END AS title,
         CASE WHEN page_id % 10 <> 7 THEN concat(html, ' see www.x', page_id, '.org/a  end') END AS text
  FROM pages
)"""
    scaled = ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in FEATURES
    )
    feature_columns = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in _LONG_FEATURES else _r6(c) for c in FEATURES)
    return {
        "kcore": _sql(core, "SELECT user_id, parent_asin, count(*) AS n_reviews FROM core GROUP BY ALL"),
        "kcore_ids": _sql(
            core,
            "SELECT 'user_id' AS side, user_id AS id, count(*) AS n_reviews FROM core GROUP BY ALL UNION ALL "
            "SELECT 'parent_asin', parent_asin, count(*) FROM core GROUP BY ALL",
        ),
        "kcore_reviews": _sql(
            core,
            "SELECT user_id, parent_asin, timestamp, rating, verified_purchase, helpful_vote, title, "
            "md5(text) AS text_md5 FROM reviews WHERE user_id IN (SELECT user_id FROM core) "
            "AND parent_asin IN (SELECT parent_asin FROM core)",
        ),
        "clean_text": _sql([pages, _cleaned("pages_reviews")], "SELECT page_id, title, text, review_text FROM cleaned"),
        "embed_text": _sql(
            [_embedded("vectors", "documents", "doc_id", "text")], f"SELECT doc_id, pos, {_r6('value')} FROM vectors"
        ),
        "embed_text_norms": (
            f"SELECT doc_id, CAST({ENCODER_DIM} AS BIGINT) AS dim, "
            "CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm "
            "FROM documents"
        ),
        "user_features": _sql(feature_ctes, f"SELECT user_id, {feature_columns} FROM features"),
        "burstiness": _sql(feature_ctes, "SELECT user_id, burstiness FROM bursts"),
        "rating_hist": _sql([_REVIEWS, _HIST], "SELECT user_id, rating, n FROM hist"),
        "rating_entropy": _sql([_REVIEWS, _HIST, _ENTROPY], f"SELECT user_id, {_r6('rating_entropy')} FROM entropy"),
        "standard_scale": _sql(feature_ctes, f"SELECT user_id, {scaled} FROM features"),
        "minmax_scale": _sql(
            feature_ctes,
            "SELECT user_id, round((avg_rating - min(avg_rating) OVER ()) / "
            "(max(avg_rating) OVER () - min(avg_rating) OVER ()), 6) + 0.0 AS scaled FROM features",
        ),
        "iforest_trust": _sql([*feature_ctes, *_forest()], f"SELECT user_id, {_r6('trust_score')} FROM trust"),
        "iforest_trust_range": _sql(
            [_REVIEWS],
            "SELECT count(DISTINCT user_id) AS n_users, 0.0::DOUBLE AS min_trust, 1.0::DOUBLE AS max_trust, "
            "0::BIGINT AS n_outside FROM reviews",
        ),
        "item_trust": _sql(
            [_REVIEWS, _HIST, _ENTROPY, _TRUST, _SPLIT, _item_trust("train")],
            f"SELECT parent_asin, {_r6('item_trust_factor')} FROM item_trust",
        ),
        "item_trust_flagged": _sql(
            [
                _REVIEWS,
                _HIST,
                _ENTROPY,
                _TRUST.replace("trust AS", "every_trust AS"),
                "trust AS (SELECT * FROM every_trust WHERE trust_score < 0.9)",
                _item_trust("reviews"),
            ],
            f"SELECT parent_asin, {_r6('item_trust_factor')} FROM item_trust",
        ),
        "suspicious_users": _sql(
            [_REVIEWS, _HIST, _ENTROPY, _TRUST],
            f"SELECT user_id, trust_score FROM trust ORDER BY trust_score, user_id LIMIT {REPORT_ROWS}",
        ),
        "suspicious_reviews": _sql(
            [
                _REVIEWS,
                _HIST,
                _ENTROPY,
                _TRUST,
                f"worst AS (SELECT * FROM trust ORDER BY trust_score, user_id LIMIT {REPORT_ROWS})",
                "mine AS (SELECT * EXCLUDE (embedding) FROM reviews JOIN worst USING (user_id))",
                _cleaned("mine"),
            ],
            "SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp, parent_asin, "
            "rating, verified_purchase, helpful_vote NULLS FIRST, title, text) = 1",
        ),
        "user_profiles": _sql([_REVIEWS, _PROFILES], f"SELECT user_id, pos, {_r6('value')} FROM up_long"),
        "item_profiles": _sql([_REVIEWS, _PROFILES], f"SELECT parent_asin, pos, {_r6('value')} FROM ip_long"),
        "cosine_topk": _sql(
            [*_BASE, "everyone AS (SELECT user_id FROM up)", _ranking("everyone_base", "everyone", "1.0", 10)],
            f"{scores} everyone_base",
        ),
        "rank_all_users": _sql(
            [
                _REVIEWS,
                _HIST,
                _ENTROPY,
                _TRUST,
                _item_trust("reviews"),
                _PROFILES,
                "everyone AS (SELECT user_id FROM up)",
                _ranking("everyone_trust", "everyone", _FACTOR, _DEEP),
            ],
            f"{scores} everyone_trust",
        ),
        "rank_baseline": _sql([*_BASE, _BASELINE], f"{scores} base"),
        "rank_trust": _sql([*_BASE, _TRUSTED], f"{scores} trusted"),
        "rank_trust_rounds": _sql([*_BASE, _TRUSTED], f"{scores} trusted"),
        "temporal_split": _sql(
            [_REVIEWS, _SPLIT],
            "SELECT user_id, parent_asin, timestamp, 'train' AS part FROM train UNION ALL "
            "SELECT user_id, parent_asin, timestamp, 'test' FROM test",
        ),
        "ground_truth": _sql([_REVIEWS, _SPLIT], "SELECT user_id, parent_asin FROM truth"),
        "eval_users": _sql([_REVIEWS, _SPLIT], "SELECT user_id FROM evaluable"),
        "precision_at_k": _sql(base_scored, f"SELECT user_id, k, {_r6('precision')} FROM scored"),
        "ndcg_at_k": _sql(base_scored, f"SELECT user_id, k, {_r6('ndcg')} FROM scored"),
        "rank_metrics": _sql(
            [*base_scored, _means("means", "scored")], f"SELECT metric, k, {_r6('value')} FROM means"
        ),
        "metric_delta": _sql(
            [
                *both,
                *_COMPARED,
            ],
            compared,
        ),
        "rank_shift": _sql([*both, _SHIFTS], f"SELECT parent_asin, {_r6('shift')} FROM shifts"),
        "rank_shift_overall": _sql(
            [*both, _SHIFTS], "SELECT round(coalesce(avg(shift), 0), 6) + 0.0 AS mean_shift FROM shifts"
        ),
        "most_demoted": _sql(
            [*both, _SHIFTS, f"rounded AS (SELECT parent_asin, {_r6('shift')} FROM shifts)"],
            f"SELECT parent_asin, shift FROM rounded ORDER BY shift, parent_asin LIMIT {REPORT_ROWS}",
        ),
        "run_summaries": _sql(
            _whole_run(),
            " UNION ALL ".join(
                f"SELECT '{step}' AS step, '{metric}' AS metric, CAST(({value}) AS DOUBLE) AS value"
                for step, metric, value in (
                    ("reviews_raw", "rows", "SELECT count(*) FROM all_reviews"),
                    ("reviews_raw", "malformed", "0"),
                    ("reviews_raw", "without_id", "0"),
                    *[(t, "rows", "SELECT count(*) FROM core_rows") for t in ("reviews", "reviews_clean", "review_embeddings")],
                    ("features", "users", "SELECT count(*) FROM features"),
                    ("user_profiles", "rows", "SELECT count(DISTINCT user_id) FROM core_rows"),
                    ("item_profiles", "rows", "SELECT count(DISTINCT parent_asin) FROM core_rows"),
                    ("features_trust", "min_trust", "SELECT min(trust_score) FROM trust"),
                    ("features_trust", "max_trust", "SELECT max(trust_score) FROM trust"),
                )
            ),
        ),
        "run_scores": _sql(
            _whole_run(), f"SELECT user_id, {feature_columns}, {_r6('trust_score')} FROM features JOIN trust USING (user_id)"
        ),
        "full_run": _sql(_whole_run(), compared),
        "full_run_baseline": _sql(_whole_run(), f"SELECT metric, k, {_r6('value')} FROM means_base"),
    }
