"""Operator 7 in SQL: the counts, and the robust estimates step by step, for the default plan."""

from __future__ import annotations

from linkloom.llm.quality import FEATURES, OutlierPlan, chi_square_cdf, chi_square_quantile

PLAN = OutlierPlan()
D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
SUMS = ["n", *(f"s{i}" for i in range(D)), *(f"p{i}{j}" for i, j in PAIRS)]


def _num(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _factor(cov: str) -> str:
    """The lower factor's columns, each naming those before it."""
    out = []
    for i, j in PAIRS:
        rest = cov.format(i=i, j=j, floor=f" + {_num(PLAN.spread_floor[i] ** 2)}" if i == j else "") + "".join(f" - c{i}{k} * c{j}{k}" for k in range(j))
        out.append(f"sqrt(greatest({rest}, {_num(1e-12)})) AS c{i}{j}" if i == j else f"({rest}) / c{j}{j} AS c{i}{j}")
    return ", ".join(out)


def _estimate(keys: str, source: str, scale: float) -> str:
    """Centers and factors from sums."""
    means = ", ".join(f"s{i} / n AS m{i}" for i in range(D))
    return f"SELECT {keys}, {means}, {_factor(f'(p{{i}}{{j}} / n - m{{i}} * m{{j}}) * {_num(scale)}{{floor}}')} FROM ({source})"


def _total(extra: str = "") -> str:
    return ", ".join(["count(*)::DOUBLE AS n", *(f"sum(f{i}) AS s{i}" for i in range(D)), *(f"sum(f{i} * f{j}) AS p{i}{j}" for i, j in PAIRS)]) + extra


def _squared() -> str:
    """Columns ``z0``.. and ``sq``, the squared distance."""
    z = [f"(f{i} - m{i}" + "".join(f" - c{i}{k} * z{k}" for k in range(i)) + f") / c{i}{i} AS z{i}" for i in range(D)]
    return ", ".join(z) + ", " + " + ".join(f"z{i} * z{i}" for i in range(D)) + " AS sq"


def _step(before: str) -> str:
    """One concentration step from the estimates of ``before``."""
    scale = PLAN.half / chi_square_cdf(chi_square_quantile(PLAN.half, D), D + 2)
    near = f"SELECT key, start, floor(ln(sq + {_num(1e-9)}) * 32) AS step, {', '.join(f'f{i}' for i in range(D))} FROM (SELECT *, {_squared()} FROM pool JOIN {before} USING (key))"
    pooled = f"SELECT key, start, step, {_total()} FROM ({near}) GROUP BY key, start, step"
    within = f"SELECT *, sum(n) OVER (PARTITION BY key, start ORDER BY step) - n AS earlier, sum(n) OVER (PARTITION BY key, start) AS every_ FROM ({pooled})"
    kept = f"SELECT key, start, {', '.join(f'sum({c}) AS {c}' for c in SUMS)} FROM ({within}) WHERE earlier < every_ * {_num(PLAN.half)} GROUP BY key, start"
    return _estimate("key, start", kept, scale)


_ROWS = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, CASE WHEN lang IS NULL THEN '1' ELSE '0' || lang END AS lang_key, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
grams AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS g FROM w WHERE len(ws) >= 5),
again AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
inside AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, range(5) AS r(k) GROUP BY rid),
told AS (
  SELECT rid, doc_id, lang_key, length(lang_key) || ':' || lang_key || source_key AS group_key, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
         (len(text) - len(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_capitals
  FROM d JOIN w USING (rid) LEFT JOIN inside USING (rid)),
x AS MATERIALIZED (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
         ln((word_chars + 25.0::DOUBLE) / (n_words + 5.0::DOUBLE)) AS f0, ln(0.01::DOUBLE + n_symbols / (word_chars + 50.0::DOUBLE)) AS f1, ln(0.05::DOUBLE + n_dup_lines / (len(lines) + 2.0::DOUBLE)) AS f2,
         ln(0.05::DOUBLE + n_repeat_words / (n_words + 20.0::DOUBLE)) AS f3, ln(0.05::DOUBLE + n_capitals / (word_chars + 50.0::DOUBLE)) AS f4
  FROM told)"""


def sql() -> str:
    """Starts, trial steps, the least determinant, steps until settled, and the verdicts."""
    floors = "[" + ", ".join(_num(f) for f in PLAN.spread_floor) + "]"
    fs = ", ".join(f"f{i}" for i in range(D))
    size = " + ".join(f"ln(c{i}{i})" for i in range(D))
    columns = ", ".join(["key", *(f"m{i}" for i in range(D)), *(f"c{i}{j}" for i, j in PAIRS)])
    middle = ", ".join([*(f"max(b) FILTER (i = {i + 1}) AS m{i}" for i in range(D)), *(f"max(spread) FILTER (i = {i + 1}) AS c{i}{j}" if i == j else f"0.0::DOUBLE AS c{i}{j}" for i, j in PAIRS)])
    directions = ", ".join(f"(f{i} - m{i}) / c{i}{i} AS z{i}" for i in range(D)) + f", greatest({' + '.join(f'z{i} * z{i}' for i in range(D))}, {_num(1e-12)}) AS len_"
    signs = ", ".join(f"sum(z{i} * z{j} / len_) AS p{i}{j}" for i, j in PAIRS)
    turned = ", ".join(f"p{i}{j} / n * {D} * k{i} * k{j} AS q{i}{j}" for i, j in PAIRS)
    parts = [
        _ROWS.strip(),
        f"good AS (SELECT lang_key, group_key, {fs} FROM x WHERE NOT base_failed)",
        "cnt AS (SELECT lang_key, group_key, count(*) AS n FROM good GROUP BY ALL)",
        f"keys AS (SELECT group_key, lang_key, CASE WHEN n >= {PLAN.least_rows} THEN 'g' || group_key WHEN sum(n) OVER (PARTITION BY lang_key) >= {PLAN.least_rows} THEN 'l' || lang_key ELSE 'all' END AS key FROM cnt)",
        "members AS (SELECT group_key, k AS key FROM (SELECT group_key, unnest(['g' || group_key, 'l' || lang_key, 'all']) AS k FROM keys) WHERE k IN (SELECT key FROM keys))",
        f"pool AS MATERIALIZED (SELECT key, {fs} FROM good JOIN members USING (group_key))",
        f"bins AS (SELECT key, i, floor(f * 64) AS bin, count(*) AS n FROM (SELECT key, unnest(range(1, {D + 1})) AS i, unnest([{fs}]) AS f FROM pool) GROUP BY ALL)",
        "upto AS (SELECT key, i, bin, sum(n) OVER (PARTITION BY key, i ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY key, i) AS every_ FROM bins)",
        "quart AS (SELECT key, i, " + ", ".join(f"min(CASE WHEN upto >= every_ * {q}::DOUBLE THEN (bin + 0.5::DOUBLE) / 64 END) AS {c}" for q, c in ((0.25, "a"), (0.5, "b"), (0.75, "c"))) + " FROM upto GROUP BY key, i)",
        f"start0 AS MATERIALIZED (SELECT key, {middle} FROM (SELECT *, greatest((c - a) / 1.349::DOUBLE, {floors}[i]) AS spread FROM quart) GROUP BY key)",
        f"start1 AS ({_estimate('key', f'SELECT key, {_total()} FROM pool GROUP BY key', 1.0)})",
        f"signs AS (SELECT key, count(*)::DOUBLE AS n, {signs} FROM (SELECT key, {directions} FROM pool JOIN start0 USING (key)) GROUP BY key)",
        f"turned AS (SELECT key, {', '.join(f'm{i}' for i in range(D))}, {turned} FROM signs JOIN (SELECT key, {', '.join(f'm{i}, c{i}{i} AS k{i}' for i in range(D))} FROM start0) USING (key))",
        f"start2 AS (SELECT key, {', '.join(f'm{i}' for i in range(D))}, {_factor('q{i}{j}{floor}')} FROM turned)",
        "e0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {columns}, {s} AS start FROM start{s}" for s in range(3)) + ")",
    ]
    for t in range(PLAN.trial_steps):
        parts.append(f"e{t + 1} AS MATERIALIZED ({_step(f'e{t}')})")
    t = PLAN.trial_steps
    parts.append(f"b{t} AS MATERIALIZED (SELECT *, false AS done FROM e{t} QUALIFY row_number() OVER (PARTITION BY key ORDER BY round({size}, 9), start) = 1)")
    for t in range(PLAN.trial_steps + 1, PLAN.steps + 1):
        old, new = f"b{t - 1}", f"n{t}"
        parts.append(f"{new} AS MATERIALIZED ({_step(f'(SELECT * EXCLUDE (done) FROM {old})')})")
        moved = f"(SELECT 2 * max(abs(a.size - b.size)) FROM (SELECT key, {size} AS size FROM {new}) a JOIN (SELECT key, {size} AS size FROM {old}) b USING (key))"
        parts.append(
            f"b{t} AS MATERIALIZED (SELECT {columns}, start, true AS done FROM {old} WHERE (SELECT bool_or(done) FROM {old})"
            f" UNION ALL SELECT {columns}, start, coalesce({moved} <= {_num(PLAN.settled)}, true) FROM {new} WHERE NOT (SELECT bool_or(done) FROM {old}))"
        )
    parts.append(f"own AS (SELECT group_key, {columns.removeprefix('key, ')} FROM b{PLAN.steps} JOIN keys USING (key))")
    counts = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    limit = _num(chi_square_quantile(PLAN.keep, D))
    return f"WITH {', '.join(parts)} SELECT {counts}, NOT base_failed AND coalesce(sq <= {limit}, true) AS kept FROM (SELECT x.*, {_squared()} FROM x LEFT JOIN own USING (group_key))"
