"""Plain SQL for the registered queries, to check them against another engine on the same tables."""

from __future__ import annotations

from clickloom.functions.scalars import FINE_TIME_EDGES, TIME_EDGES
from clickloom.plans.standins import CAPS, DIM, DOMAINS, FEAT, VOCAB_ID, VOCAB_ITEM

REQUEST_TS = 1706745600

BEH = """beh AS (
  SELECT event_id, user_id, event_type AS domain, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 + CAST(floor(value) AS BIGINT) AS id,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, value
  FROM events)"""

# the events with user and day as one number: each lies in exactly one wide row
DAYS = BEH.replace("beh AS", "single AS") + """,
beh AS (SELECT * REPLACE (user_id * 100000 + ts // 86400 AS user_id) FROM single)"""

KEPT = """recent AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY ts DESC, event_id DESC) AS recency FROM beh),
kept AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY ts, event_id) - 1 AS pos FROM recent)"""

USERS = "users AS (SELECT user_id, max(ts) AS req FROM beh GROUP BY user_id)"

FEATS = """feat AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         l_extendedprice * (1 - l_discount) AS net, nullif(l_tax, 0) AS tax_known,
         CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS label_type
  FROM lineitem)"""

ACCT = """acct AS (
  SELECT c_custkey, c_acctbal, CAST(c_nationkey - 3 AS BIGINT) AS nation,
         CASE WHEN c_nationkey <> 7 THEN CAST(floor(c_acctbal) AS BIGINT) END AS balance
  FROM customer)"""

WORDS = """pieces AS (SELECT doc_id, string_split(text, ' ') AS parts FROM documents),
word AS (
  SELECT doc_id, pos - 1 AS pos, CAST(length(w) - 3 AS BIGINT) AS v
  FROM (SELECT doc_id, unnest(parts) AS w, generate_subscripts(parts, 1) AS pos FROM pieces))"""

SCORED = """scored AS (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE ((l_partkey * 7 + l_suppkey) % 41 - 20) / 8.0 END AS z,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y
  FROM lineitem),
known AS (SELECT CAST(z AS DOUBLE) AS z, y FROM scored WHERE z IS NOT NULL)"""

DOMAIN_CAPS = "caps(domain, n) AS (VALUES " + ", ".join(f"('{d}', {CAPS[d]})" for d in DOMAINS) + ")"
PAIRS = "pairs(domain_a, domain_b) AS (VALUES " + ", ".join(
    f"('{a}', '{b}')" for i, a in enumerate(DOMAINS) for b in DOMAINS[i + 1 :]
) + ")"


def positions(n: int) -> str:
    return f"pos_n AS (SELECT range AS pos FROM range({n}))"


def long_sql(columns: list[str], source: str) -> str:
    parts = [f'SELECT \'{c}\' AS "column", CAST({c} AS DOUBLE) AS v FROM {source}' for c in columns]
    return "long AS (" + " UNION ALL ".join(parts) + ")"


def bucket(request: str, event: str, edges: list[int]) -> str:
    diff = f"greatest({request} - {event}, 0)"
    found = " + ".join(f"CASE WHEN {diff} > {e} THEN 1 ELSE 0 END" for e in edges)
    return f"CASE WHEN {event} > 0 THEN CAST(least({found}, {len(edges) - 1}) + 1 AS BIGINT) ELSE 0 END"


def scalar_stats(columns: list[str], source: str, ctes: str) -> str:
    return f"""WITH {ctes}, {long_sql(columns, source)}
SELECT "column", count(*) AS total, count(*) FILTER (v <= 0) AS missing_count,
       count(*) FILTER (v <> 0) AS valid_count,
       round(min(v) FILTER (v <> 0), 6) AS min, round(max(v) FILTER (v <> 0), 6) AS max,
       round(avg(v) FILTER (v <> 0), 6) AS mean, round(stddev_samp(v) FILTER (v <> 0), 6) AS std,
       round(quantile_cont(v, 0.5) FILTER (v <> 0), 6) AS p50,
       round(quantile_cont(v, 0.9) FILTER (v <> 0), 6) AS p90,
       round(quantile_cont(v, 0.99) FILTER (v <> 0), 6) AS p99,
       round(count(*) FILTER (v <= 0) / count(*), 6) AS missing_rate
FROM long GROUP BY 1"""


def seq_length(lengths: str, ctes: str) -> str:
    return f"""WITH {ctes}, lengths AS ({lengths})
SELECT domain, count(*) AS n_rows, round(avg(valid_len), 6) AS mean_len, max(valid_len) AS max_len,
       max(raw_len) AS max_raw_len,
       round(count(*) FILTER (valid_len = 0) / count(*), 6) AS zero_seq_rate,
       round(quantile_cont(CAST(valid_len AS DOUBLE), 0.5), 6) AS p50,
       round(quantile_cont(CAST(valid_len AS DOUBLE), 0.9), 6) AS p90,
       round(quantile_cont(CAST(valid_len AS DOUBLE), 0.99), 6) AS p99,
       CAST(floor(quantile_cont(CAST(valid_len AS DOUBLE), 0.9)) AS BIGINT) AS suggested_cap
FROM lengths GROUP BY domain"""


def lengths_of(source: str) -> str:
    return f"""SELECT u.user_id, d.domain, count(*) FILTER (e.item > 0) AS valid_len, count(e.item) AS raw_len
FROM users u CROSS JOIN caps d LEFT JOIN {source} e ON e.user_id = u.user_id AND e.domain = d.domain
GROUP BY 1, 2"""


def first_item(domain: str, field: str) -> str:
    return f"(SELECT {field} FROM kept k WHERE k.user_id = u.user_id AND k.domain = '{domain}' AND k.pos = 0)"


WIDE_SCALARS = f"""wide AS (
  SELECT u.user_id, u.req, {first_item('view', 'item')} AS f1, {first_item('view', 'id')} AS f2,
         {first_item('purchase', 'item')} AS f4,
         (SELECT count(*) FROM kept k WHERE k.user_id = u.user_id AND k.domain = 'purchase') AS n_purchase
  FROM users u)"""

CLEAN_ITEM = f"CASE WHEN k.item > 0 AND k.item < {VOCAB_ITEM} THEN k.item ELSE 0 END"
CLEAN_ID = f"CASE WHEN k.id > 0 AND k.id < {VOCAB_ID} THEN k.id ELSE 0 END"
F1 = "CASE WHEN f1 > 0 AND f1 < 80 THEN f1 ELSE 0 END"
F4 = f"CASE WHEN f4 > 0 AND f4 < {VOCAB_ITEM} THEN f4 ELSE 0 END"
LIST3 = f"""list3 AS (
  SELECT u.user_id, p.pos, coalesce({CLEAN_ITEM}, 0) AS v
  FROM users u CROSS JOIN pos_n p LEFT JOIN kept k ON k.user_id = u.user_id AND k.domain = 'click' AND k.pos = p.pos
  WHERE p.pos < 4)"""

OBSERVED = """fields AS (
  SELECT domain, 'ts' AS "column", 0 AS ord, ts AS v FROM beh
  UNION ALL SELECT domain, 'id', 1, id FROM beh UNION ALL SELECT domain, 'item', 2, item FROM beh),
obs AS (
  SELECT domain, "column", CAST(ord AS BIGINT) AS ord, max(v) + 1 AS vocab,
         coalesce(avg(CASE WHEN v BETWEEN 1577836800 AND 1893456000 THEN 1.0 ELSE 0.0 END) FILTER (v > 0) > 0.8, false) AS is_ts,
         CAST(ord AS BIGINT) AS fid
  FROM fields GROUP BY 1, 2, 3)"""

ID_COUNTS = """idc AS (
  SELECT domain || '/id' AS "column", id AS v FROM beh UNION ALL SELECT domain || '/item', item FROM beh
  UNION ALL SELECT domain || '/ts', ts FROM beh)"""

DECLARED = "declared(\"column\", vocab, is_ts) AS (VALUES " + ", ".join(
    f"('{d}/{n}', CAST({v} AS BIGINT), {'true' if n == 'ts' else 'false'})"
    for d in DOMAINS
    for n, v in (("id", 5_000_000), ("item", 100), ("ts", 1_772_725_488), ("unseen", 10))
) + ")"

VEC = """vec AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def present(c: str, source: str) -> str:
    """Share of rows in which a column is neither NULL nor 0."""
    return f"(SELECT count(*) FILTER ({c} <> 0) / count(*) FROM {source})"


def corr_sql(columns: list[str], source: str) -> str:
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, corr(nullif({a}, 0), nullif({b}, 0)) AS r "
                f"FROM {source} WHERE {a} <> 0 AND {b} <> 0 "
                f"HAVING {present(a, source)} > 0.2 AND {present(b, source)} > 0.2"
            )
    return " UNION ALL ".join(parts)


def iqr_sql(source_ctes: str, columns: list[str], source: str) -> str:
    return f"""{source_ctes}, {long_sql(columns, source)}, pos AS (SELECT * FROM long WHERE v > 0),
q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM pos GROUP BY 1),
lim AS (SELECT *, q1 - 3 * (q3 - q1) AS lower, q3 + 3 * (q3 - q1) AS upper FROM q),
o AS (
  SELECT "column", q1, q3, lower, upper, count(*) AS n, count(*) FILTER (v < lower OR v > upper) AS outlier_count
  FROM pos JOIN lim USING ("column") GROUP BY ALL),
outl AS (
  SELECT *, outlier_count / n AS rate,
         CASE WHEN outlier_count / n > 0.01 THEN 'severe' WHEN outlier_count / n > 0.0001 THEN 'mild' ELSE 'rare' END AS severity
  FROM o WHERE n >= 10 AND outlier_count > 0)"""


def tail_sql(order: str, source: str, keep: str, train_ratio: float) -> str:
    train = "n - v" if train_ratio >= 1 else f"greatest(1, CAST(floor((n - v) * {train_ratio}) AS BIGINT))"
    return f"""
sized AS (
  SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rk, count(*) OVER () AS n,
         greatest(1, CAST(floor(count(*) OVER () * 0.1) AS BIGINT)) AS v
  FROM {source})
SELECT {keep}, CASE WHEN rk >= n - v THEN 'valid' WHEN rk < {train} THEN 'train' ELSE 'dropped' END AS split FROM sized"""


def hash52(seed: int, c: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({c} AS VARCHAR)), 1, 13)) AS BIGINT)"


POOL = f"""items AS (SELECT user_id, domain, item FROM beh WHERE item > 0),
pooled AS (
  SELECT user_id, domain, pos, avg(x) AS v FROM items JOIN vec ON vec.vec_id = items.item GROUP BY 1, 2, 3),
groups AS (SELECT user_id, domain, count(*) FILTER (item > 0) AS n_valid FROM beh GROUP BY 1, 2)"""

TARGETS = f"""bought AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
                 FROM beh WHERE domain = 'purchase') WHERE r <= 4),
target AS (
  SELECT user_id, pos, avg(x) AS t FROM bought JOIN vec ON vec.vec_id = bought.item
  WHERE item > 0 GROUP BY 1, 2),
cand AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency
                 FROM beh WHERE item > 0) WHERE recency <= 256),
pairs AS (SELECT DISTINCT user_id, item FROM cand),
dots AS (
  SELECT p.user_id, p.item, sum(v.x * t.t) AS score
  FROM pairs p JOIN vec v ON v.vec_id = p.item JOIN target t ON t.user_id = p.user_id AND t.pos = v.pos GROUP BY 1, 2),
ranked AS (
  SELECT c.user_id, c.recency, c.event_id, c.item, coalesce(d.score, 0.0) AS score,
         row_number() OVER (PARTITION BY c.user_id ORDER BY round(coalesce(d.score, 0.0), 12) DESC, c.recency) AS rank
  FROM cand c LEFT JOIN dots d USING (user_id, item))"""

VIRTUAL = f"""vid AS (
  SELECT user_id, 'user_int_feats_1' AS "column", CASE WHEN f1 > 0 THEN 1 + f1 % 32 + 1 ELSE 0 END AS virtual_id FROM wide
  UNION ALL SELECT user_id, 'user_int_feats_2', CASE WHEN f2 > 0 THEN 34 + f2 % 32 + 1 ELSE 0 END FROM wide
  UNION ALL SELECT user_id, 'item_int_feats_4', CASE WHEN f4 > 0 THEN 1 + f4 % 32 + 1 ELSE 0 END FROM wide)"""

MEASURES = """m AS (
  SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS a0, CAST(len(string_split(text, ' ')) AS DOUBLE) AS a1,
         CAST(len(string_split(text, chr(10))) AS DOUBLE) AS a2, length(text) / len(string_split(text, ' ')) AS a3,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE) AS a4,
         CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) AS a5
  FROM labels l JOIN documents d USING (doc_id))"""

def melt(section: str, source: str, name: str, values: list[str], texts: list[str] = []) -> list[str]:
    """Metric rows ``(section, column, metric, value, text)`` of a table of named columns."""
    row = "SELECT '{s}' AS section, {n} AS \"column\", '{m}' AS metric, {v} AS value, {t} AS text FROM {f}"
    out = [row.format(s=section, n=name, m=v, v=f"round(CAST({v} AS DOUBLE), 6)", t="CAST(NULL AS VARCHAR)", f=source) for v in values]
    return out + [row.format(s=section, n=name, m=t, v="CAST(NULL AS DOUBLE)", t=t, f=source) for t in texts]


FIELDS = [("item", 1, VOCAB_ITEM), ("id", 2, VOCAB_ID), ("ts", 3, 0)]


def seq_fields(source: str) -> str:
    return " UNION ALL ".join(f"SELECT domain, domain || '_seq_{n}' AS c, {f} AS v FROM {source}" for f, n, _ in FIELDS)


def declared_rows() -> str:
    return ", ".join(f"('{d}_seq_{n}', {v}, {'true' if f == 'ts' else 'false'})" for d in DOMAINS for f, n, v in FIELDS)


def exact_mean6(v: str) -> str:
    """The mean of ``v`` to 6 decimals, half away from zero, from the exact sum of each double's shortest decimal form.

    Integer arithmetic throughout: a float average can fall on either side of a mean that is exactly a tie (0.0399315).
    """
    s = f"sum(CAST(CAST(CAST({v} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)))"
    a = f"(CAST(floor({s}) AS HUGEINT) * CAST(1000000000000000000 AS HUGEINT) + CAST(({s} - floor({s})) * 1000000000000000000 AS HUGEINT))"
    d = f"(CAST(count({v}) AS HUGEINT) * CAST(1000000000000 AS HUGEINT))"
    q = f"(abs({a}) // {d} + CASE WHEN 2 * (abs({a}) % {d}) >= {d} THEN 1 ELSE 0 END)"
    return f"CASE WHEN count({v}) > 0 THEN sign({a}) * CAST({q} AS DOUBLE) / 1000000 END"


def incremental_sql(mean: str = "round(avg(v), 6)") -> str:
    bounds = ", ".join(f"true AS {c}_in_bounds" for c in ("p50", "p90", "p99", "distinct"))
    return f"""SELECT "column", count(*) AS total, count(*) - count(v) AS null_count, round((count(*) - count(v)) / count(*), 6) AS null_rate,
       count(v) AS valid_count, round(min(v), 6) AS min, round(max(v), 6) AS max, {mean} AS mean,
       round(stddev_pop(v), 6) AS std, {bounds} FROM long GROUP BY 1"""


def report_sql() -> str:
    """All sections of the report over the wide rows. Needs ``wide``, ``kept`` and ``lengths``."""
    scalars = {"user_int_feats_1": "f1", "user_int_feats_2": "f2", "item_int_feats_4": "f4"}
    cols = list(scalars)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    corr = " UNION ALL ".join(
        f"SELECT '{a}/{b}' AS c, round(corr(nullif({a}, 0), nullif({b}, 0)), 4) AS pearson FROM s3 WHERE {a} <> 0 AND {b} <> 0 "
        f"HAVING {present(a, 's3')} > 0.2 AND {present(b, 's3')} > 0.2"
        for a, b in pairs
    )
    seq, declared = seq_fields("kept"), declared_rows()
    domain_pairs = ", ".join(f"('{a}', '{b}')" for i, a in enumerate(DOMAINS) for b in DOMAINS[i + 1 :])
    sections = [
        *melt("label", "lab", "'label_type'", ["positive", "negative", "total", "pos_rate", "neg_per_pos"]),
        """SELECT 'label_counts', CASE WHEN n_purchase % 2 = 1 THEN '2' ELSE '1' END, 'count', CAST(count(*) AS DOUBLE), NULL
           FROM wide GROUP BY 2""",
        *[f"SELECT 'fields', '{d}', '{m}', NULL, '{d}_seq_1'" for d in DOMAINS for m in ("length_field", "overlap_field")],
        "SELECT 'fields', 'scalars', 'correlated_columns', 3, NULL",
        *melt("domain_coverage", "cover", "domain", ["with_seq", "without_seq", "coverage"]),
        *melt("seq_length", "slen", "domain",
              ["mean_len", "p50", "p90", "p99", "max_len", "max_raw_len", "zero_seq_rate", "suggested_cap"]),
        *melt("scalar", "stats", "c",
              ["total", "missing_count", "missing_rate", "valid_count", "min", "max", "mean", "std", "p50", "p90", "p99"]),
        *melt("missing", "(SELECT * FROM stats WHERE missing_rate > 0.01)", "c", ["missing_count", "missing_rate"]),
        "SELECT 'scalar_top', c, 'top' || r, CAST(n AS DOUBLE), CAST(CAST(v AS BIGINT) AS VARCHAR) FROM stop WHERE r <= 10",
        *melt("correlation", "strong", "c", ["pearson"]),
        *melt("outliers", "outl", '"column"', ["outlier_count", "outlier_rate"], ["severity"]),
        *melt("array", "arr", "'user_int_feats_3'", ["max_dim", "total_values", "valid_count", "missing_rate", "min", "max", "mean"]),
        "SELECT 'array_top', 'user_int_feats_3', 'top' || r, CAST(n AS DOUBLE), CAST(v AS VARCHAR) FROM atop WHERE r <= 10",
        *melt("vocab", "voc", "c", ["vocab", "unique_ids", "coverage_rate"], ["note"]),
        *melt("timestamp", "stamp", "c", ["in_range", "declared"]),
        *melt("overlap", "shared", "a || '/' || b", ["unique_a", "unique_b", "overlap", "rate_a", "rate_b", "share"]),
    ]
    values = " UNION ALL ".join(f'SELECT \'{c}\' AS "column", {c} AS v FROM s3' for c in cols)
    return f"""s3 AS (SELECT {", ".join(f"CAST({f} AS DOUBLE) AS {c}" for c, f in scalars.items())} FROM wide),
long AS ({values}),
lab AS (
  SELECT count(*) FILTER (n_purchase % 2 = 1) AS positive, count(*) FILTER (n_purchase % 2 = 0) AS negative, count(*) AS total,
         positive / greatest(total, 1) AS pos_rate, negative / greatest(positive, 1) AS neg_per_pos FROM wide),
cover AS (
  SELECT domain, count(*) FILTER (valid_len > 0) AS with_seq, count(*) FILTER (valid_len = 0) AS without_seq,
         with_seq / count(*) AS coverage FROM lengths GROUP BY 1),
slen AS (
  SELECT domain, avg(valid_len) AS mean_len, quantile_cont(CAST(valid_len AS DOUBLE), 0.5) AS p50,
         quantile_cont(CAST(valid_len AS DOUBLE), 0.9) AS p90, quantile_cont(CAST(valid_len AS DOUBLE), 0.99) AS p99,
         max(valid_len) AS max_len, max(raw_len) AS max_raw_len, count(*) FILTER (valid_len = 0) / count(*) AS zero_seq_rate,
         floor(p90) AS suggested_cap FROM lengths GROUP BY 1),
stats AS (
  SELECT "column" AS c, count(*) AS total, count(*) FILTER (v <= 0) AS missing_count, missing_count / total AS missing_rate,
         count(*) FILTER (v <> 0) AS valid_count, min(v) FILTER (v <> 0) AS min, max(v) FILTER (v <> 0) AS max,
         avg(v) FILTER (v <> 0) AS mean, stddev_samp(v) FILTER (v <> 0) AS std, quantile_cont(v, 0.5) FILTER (v <> 0) AS p50,
         quantile_cont(v, 0.9) FILTER (v <> 0) AS p90, quantile_cont(v, 0.99) FILTER (v <> 0) AS p99 FROM long GROUP BY 1),
stop AS (
  SELECT "column" AS c, v, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, v) AS r
  FROM long WHERE v <> 0 GROUP BY 1, 2),
strong AS (SELECT * FROM ({corr}) WHERE abs(pearson) >= 0.9),
q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long WHERE v > 0 GROUP BY 1),
outl AS (
  SELECT "column", count(*) AS n, count(*) FILTER (v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS outlier_count,
         outlier_count / n AS outlier_rate,
         CASE WHEN outlier_rate > 0.01 THEN 'severe' WHEN outlier_rate > 0.0001 THEN 'mild' ELSE 'rare' END AS severity
  FROM long JOIN q USING ("column") WHERE v > 0 GROUP BY 1 HAVING n >= 10 AND outlier_count > 0),
clicks AS (SELECT * FROM kept WHERE domain = 'click'),
arr AS (
  SELECT coalesce(max(pos) + 1, 0) AS max_dim, count(*) AS total_values, count(*) FILTER (item > 0) AS valid_count,
         (total_values - valid_count) / greatest(total_values, 1) AS missing_rate, min(item) FILTER (item > 0) AS min,
         max(item) FILTER (item > 0) AS max, avg(item) FILTER (item > 0) AS mean FROM clicks),
atop AS (SELECT item AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS r FROM clicks WHERE item > 0 GROUP BY 1),
el AS ({seq}),
declared(c, vocab, is_ts) AS (VALUES {declared}),
seen AS (
  SELECT c, count(DISTINCT v) AS u, count(*) FILTER (v BETWEEN 1577836800 AND 1893456000) / count(*) AS in_range FROM el WHERE v > 0 GROUP BY 1),
voc AS (
  SELECT c, vocab, coalesce(u, 0) AS unique_ids, coalesce(u, 0) / greatest(vocab, 1) AS coverage_rate,
         CASE WHEN is_ts THEN 'timestamp' WHEN coalesce(u, 0) < vocab * 0.01 THEN 'shrink' ELSE '' END AS note
  FROM declared LEFT JOIN seen USING (c)),
stamp AS (SELECT c, in_range, CAST(is_ts AS INTEGER) AS declared FROM seen JOIN declared USING (c) WHERE in_range > 0.8),
ids AS (SELECT DISTINCT domain, item FROM kept WHERE item > 0),
u AS (SELECT domain, count(*) AS n FROM ids GROUP BY 1),
dp(a, b) AS (VALUES {domain_pairs}),
both_in AS (
  SELECT x.domain AS a, y.domain AS b, count(*) AS n FROM ids x JOIN ids y ON x.item = y.item AND x.domain < y.domain GROUP BY 1, 2),
shared AS (
  SELECT dp.a, dp.b, ua.n AS unique_a, ub.n AS unique_b, coalesce(k.n, 0) AS overlap, overlap / greatest(unique_a, 1) AS rate_a,
         overlap / greatest(unique_b, 1) AS rate_b, CAST(overlap / greatest(least(unique_a, unique_b), 1) > 0.3 AS INTEGER) AS share
  FROM dp LEFT JOIN both_in k ON k.a = dp.a AND k.b = dp.b JOIN u ua ON ua.domain = dp.a JOIN u ub ON ub.domain = dp.b),
rep AS ({" UNION ALL ".join(sections)}),
hits AS (
  SELECT 'imbalance' AS rule, 'label_type' AS "column", negative / positive AS value FROM lab WHERE positive > 0 AND negative / positive > 20
  UNION ALL SELECT 'missing', "column", value FROM rep WHERE section = 'missing' AND metric = 'missing_rate' AND value > 0.5
  UNION ALL SELECT 'correlated', c, pearson FROM strong
  UNION ALL SELECT 'low_coverage', domain, coverage FROM cover WHERE coverage < 0.5
  UNION ALL SELECT 'outliers', "column", NULL FROM outl WHERE severity IN ('mild', 'severe'))
SELECT * FROM rep
UNION ALL SELECT 'suggestions', "column", rule, round(value, 6), NULL FROM hits
UNION ALL SELECT 'suggestions', '-', 'ok', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM hits)"""


ORACLE: dict[str, str] = {
    "clean_scalar": f"""WITH {ACCT} SELECT c_custkey, CASE WHEN nation > 0 THEN nation ELSE 0 END AS nation,
CASE WHEN balance > 0 THEN balance ELSE 0 END AS balance FROM acct""",
    "binary_label": f"""WITH {FEATS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
CAST(label_type = 2 AS BIGINT) AS label, CAST(0 AS BIGINT) AS scoring_label FROM feat""",
    "fill_missing": f"WITH {ACCT} SELECT c_custkey, nation, coalesce(balance, -1) AS balance FROM acct",
    "oov_clip": f"""WITH {BEH} SELECT event_id, {CLEAN_ITEM} AS item, {CLEAN_ID} AS id, CAST(0 AS BIGINT) AS no_vocab FROM beh k""",
    "oov_report": f"""WITH {DAYS}, {KEPT}, {USERS}, {DOMAIN_CAPS}, {positions(4)}, {WIDE_SCALARS},
used AS (
  SELECT domain || '_seq_1' AS "column", CAST({VOCAB_ITEM} AS BIGINT) AS vocab, item AS v FROM kept JOIN caps USING (domain) WHERE pos < n
  UNION ALL SELECT domain || '_seq_2', {VOCAB_ID}, id FROM kept JOIN caps USING (domain) WHERE pos < n
  UNION ALL SELECT 'user_int_feats_1', 80, f1 FROM wide
  UNION ALL SELECT 'item_int_feats_4', {VOCAB_ITEM}, f4 FROM wide
  UNION ALL SELECT 'user_int_feats_3', {VOCAB_ITEM}, item FROM kept WHERE domain = 'click' AND pos < 4)
SELECT "column", vocab, count(*) AS oov_count, min(v) AS oov_min, max(v) AS oov_max FROM used WHERE v >= vocab GROUP BY 1, 2""",
    "label_filter": "SELECT doc_id, CAST(toxic AS BIGINT) AS toxic FROM labels WHERE quality = 1",
    "row_cap": "SELECT least(count(*), 1000) AS n_rows FROM lineitem",
    "first_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000",
    "pad_int": f"""WITH {WORDS}, {positions(16)}
SELECT d.doc_id, least(len(d.parts), 16) AS length, p.pos, CASE WHEN w.v > 0 THEN w.v ELSE 0 END AS value
FROM pieces d CROSS JOIN pos_n p LEFT JOIN word w ON w.doc_id = d.doc_id AND w.pos = p.pos""",
    "pad_float": f"""WITH {VEC}, {positions(DIM + 6)}
SELECT e.vec_id, p.pos, coalesce(v.x, 0.0) AS value
FROM embeddings e CROSS JOIN pos_n p LEFT JOIN vec v ON v.vec_id = e.vec_id AND v.pos = p.pos""",
    "valid_length": f"""WITH {WORDS} SELECT doc_id, count(*) FILTER (v > 0) AS valid_len, count(*) FILTER (v <> 0) AS nonzero,
CAST(count(*) FILTER (v > 0) > 0 AS BIGINT) AS has_valid FROM word GROUP BY doc_id""",
    "active_items": f"""WITH {DAYS}, {KEPT}
SELECT user_id, domain, row_number() OVER (PARTITION BY user_id, domain ORDER BY pos) - 1 AS pos, item AS value
FROM kept WHERE item <> 0""",
    "seq_prep": f"""WITH {DAYS}, {KEPT}, {USERS}, {DOMAIN_CAPS}, {positions(max(CAPS.values()))},
lens AS (SELECT user_id, domain, count(*) AS c FROM kept GROUP BY 1, 2),
slots(slot) AS (VALUES (0), (1))
SELECT u.user_id, d.domain, least(coalesce(l.c, 0), d.n) AS length, CAST(s.slot AS BIGINT) AS slot, p.pos,
       CASE WHEN s.slot = 0 THEN coalesce({CLEAN_ITEM}, 0) ELSE coalesce({CLEAN_ID}, 0) END AS value
FROM users u CROSS JOIN caps d CROSS JOIN slots s JOIN pos_n p ON p.pos < d.n
LEFT JOIN lens l ON l.user_id = u.user_id AND l.domain = d.domain
LEFT JOIN kept k ON k.user_id = u.user_id AND k.domain = d.domain AND k.pos = p.pos""",
    "flat_vector": f"""WITH {DAYS}, {KEPT}, {USERS}, {positions(4)}, {WIDE_SCALARS}, {LIST3},
parts AS (
  SELECT user_id, 'user_int' AS part, 0 AS pos, CAST({F1} AS DOUBLE) AS value FROM wide
  UNION ALL SELECT user_id, 'user_int', 1, 0.0 FROM wide
  UNION ALL SELECT user_id, 'user_int', pos + 2, v FROM list3
  UNION ALL SELECT user_id, 'item_int', 0, {F4} FROM wide
  UNION ALL SELECT u.user_id, 'user_dense', p.pos, coalesce(CAST(CAST(k.value AS FLOAT) AS DOUBLE), 0.0)
    FROM users u CROSS JOIN pos_n p LEFT JOIN kept k ON k.user_id = u.user_id AND k.domain = 'view' AND k.pos = p.pos
    WHERE p.pos < 3)
SELECT user_id, CAST(n_purchase % 2 AS BIGINT) AS label, part, CAST(pos AS BIGINT) AS pos, value
FROM parts JOIN (SELECT user_id, n_purchase FROM wide) USING (user_id)""",
    "feature_offsets": """SELECT c AS "column", CAST(d AS BIGINT) AS dim, CAST(o AS BIGINT) AS "offset", CAST(w AS BIGINT) AS width
FROM (VALUES ('user_int_feats_1', 1, 0, 6), ('user_int_feats_2', 1, 1, 6), ('user_int_feats_3', 4, 2, 6),
             ('item_int_feats_4', 1, 0, 1), ('user_dense_feats_5', 3, 0, 3)) t(c, d, o, w)
WHERE EXISTS (SELECT 1 FROM events)""",
    "time_bucket": f"""WITH {DAYS}, {KEPT}, {USERS}, {DOMAIN_CAPS}, {positions(max(CAPS.values()))}
SELECT u.user_id, d.domain, p.pos, coalesce({bucket("u.req", "k.ts", TIME_EDGES)}, 0) AS bucket
FROM users u CROSS JOIN caps d JOIN pos_n p ON p.pos < d.n
LEFT JOIN kept k ON k.user_id = u.user_id AND k.domain = d.domain AND k.pos = p.pos""",
    "time_bucket_fine": f"""WITH {BEH} SELECT event_id, {bucket(str(REQUEST_TS), "ts", FINE_TIME_EDGES)} AS bucket FROM beh""",
    "aligned_pairs": f"""WITH {DAYS}, {KEPT} SELECT user_id, domain, pos, item AS id, id AS weight FROM kept""",
    "misaligned_rows": f"""WITH {DAYS}, {PAIRS}, users AS (SELECT DISTINCT user_id FROM beh),
c AS (SELECT user_id, domain, count(*) AS n FROM beh GROUP BY 1, 2),
p AS (
  SELECT u.user_id, domain_a, domain_b, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM users u CROSS JOIN pairs
  LEFT JOIN c a ON a.user_id = u.user_id AND a.domain = domain_a LEFT JOIN c b ON b.user_id = u.user_id AND b.domain = domain_b)
SELECT * FROM p WHERE n_a <> n_b""",
    "tabular_matrix": f"""WITH {VEC}
SELECT vec_id, CAST(0 AS BIGINT) AS pos, CAST(coalesce(nullif(label, 3), -1) AS DOUBLE) AS value FROM embeddings
UNION ALL SELECT vec_id, pos + 1, x FROM vec
UNION ALL SELECT vec_id, {DIM + 1}, CAST(count(*) FILTER (x <> 0) AS DOUBLE) FROM vec GROUP BY vec_id""",
    "chunk_split": f"""WITH {VEC}, {positions(66)}
SELECT e.vec_id, p.pos // 11 AS chunk, p.pos % 11 AS pos, coalesce(v.x, 0.0) AS value
FROM embeddings e CROSS JOIN pos_n p LEFT JOIN vec v ON v.vec_id = e.vec_id AND v.pos = p.pos""",
    "virtual_ids": f"""WITH {DAYS}, {KEPT}, {USERS}, {WIDE_SCALARS}, {VIRTUAL} SELECT * FROM vid""",
    "observed_catalogue": f"WITH {BEH}, {OBSERVED} SELECT * FROM obs",
    "primary_field": f"""WITH {BEH}, {OBSERVED},
fit AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) - 1 AS slot FROM obs WHERE NOT is_ts)
SELECT domain, arg_min("column", ord) FILTER (vocab <= 50000) AS "column", min(fid) FILTER (vocab <= 50000) AS fid,
       min(slot) FILTER (vocab <= 50000) AS slot, arg_min(vocab, ord) FILTER (vocab <= 50000) AS vocab
FROM fit GROUP BY domain""",
    "vocab_gate": f"""WITH {BEH}, {OBSERVED} SELECT domain, "column", vocab, vocab <= 0 OR vocab > 1000000 AS skipped, vocab > 10000 AS is_id FROM obs""",
    "group_assembly": f"""WITH {DAYS}, {KEPT}, {USERS}, {positions(4)}, {WIDE_SCALARS}, {LIST3}
SELECT user_id, 'U1' AS group_name, CAST(0 AS BIGINT) AS pos, {F1} AS value FROM wide
UNION ALL SELECT user_id, 'U1', pos + 1, v FROM list3
UNION ALL SELECT user_id, 'U2', 0, 0 FROM wide""",
    "label_dist": f"""WITH {FEATS} SELECT count(*) FILTER (label_type = 2) AS positive, count(*) FILTER (label_type = 1) AS negative,
count(*) AS total, round(count(*) FILTER (label_type = 2) / greatest(count(*), 1), 6) AS pos_rate,
round(count(*) FILTER (label_type = 1) / greatest(count(*) FILTER (label_type = 2), 1), 6) AS neg_per_pos FROM feat""",
    "label_counts": f"WITH {FEATS} SELECT CAST(label_type AS BIGINT) AS label, count(*) AS count FROM feat GROUP BY 1",
    "missing_le0": f"""WITH {ACCT}, {long_sql(["c_acctbal", "nation", "balance"], "acct")}
SELECT "column", count(*) AS total, count(*) FILTER (v <= 0) AS missing_count,
       round(count(*) FILTER (v <= 0) / count(*), 6) AS missing_rate
FROM long GROUP BY 1 HAVING count(*) FILTER (v <= 0) / count(*) > 0.01""",
    "null_rate": f"""WITH {FEATS}, {long_sql(FEAT, "feat")}
SELECT "column", count(*) AS total, count(*) FILTER (v IS NULL) AS missing_count,
       round(count(*) FILTER (v IS NULL) / count(*), 6) AS missing_rate
FROM long GROUP BY 1 HAVING count(*) FILTER (v IS NULL) / count(*) > 0.01""",
    "column_census": f"WITH {FEATS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS total, count(*) - count({c}) AS null_count, "
        f"count(*) > 0 AND count({c}) = 0 AS all_null FROM feat"
        for c, k in [("l_linenumber", "scalar_int"), *[(c, "scalar_float") for c in FEAT], ("label_type", "scalar_int")]
    ),
    "scalar_stats": scalar_stats(FEAT, "feat", FEATS),
    "scalar_stats_signed": scalar_stats(["c_acctbal", "nation", "balance"], "acct", ACCT),
    "scalar_stats_pop": f"""WITH {FEATS}, {long_sql(FEAT, "feat")}
SELECT "column", count(*) AS total, count(*) - count(v) AS null_count, round((count(*) - count(v)) / count(*), 6) AS null_rate,
       count(v) AS valid_count, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
       round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90,
       round(quantile_cont(v, 0.99), 6) AS p99
FROM long GROUP BY 1""",
    "describe": f"""WITH {FEATS}, {long_sql(FEAT, "feat")}
SELECT "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
       round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75
FROM long GROUP BY 1""",
    "top_values": f"""WITH {FEATS}, {long_sql(["l_quantity", "l_discount", "l_tax"], "feat")},
c AS (SELECT "column", v AS value, count(*) AS count FROM long WHERE v <> 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c)
SELECT * FROM r WHERE rank <= 10""",
    "string_stats": """WITH t AS (
  SELECT 'lang' AS "column", nullif(lang, 'en') AS v FROM documents UNION ALL SELECT 'source', source FROM documents
  UNION ALL SELECT 'text', text FROM documents)
SELECT "column", count(*) AS total, count(*) - count(v) AS null_count, count(DISTINCT v) AS unique_count FROM t GROUP BY 1""",
    "string_top": """WITH t AS (
  SELECT 'lang' AS "column", nullif(lang, 'en') AS v FROM documents UNION ALL SELECT 'source', source FROM documents
  UNION ALL SELECT 'text', text FROM documents),
c AS (SELECT "column", v AS value, count(*) AS count FROM t WHERE v IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c)
SELECT * FROM r WHERE rank <= 20""",
    "array_stats": f"""WITH {WORDS}
SELECT 'words' AS "column", (SELECT max(len(parts)) FROM pieces) AS max_dim, count(*) AS total_values,
       count(*) FILTER (v > 0) AS valid_count, round((count(*) - count(*) FILTER (v > 0)) / count(*), 6) AS missing_rate,
       round(CAST(min(v) FILTER (v > 0) AS DOUBLE), 6) AS min, round(CAST(max(v) FILTER (v > 0) AS DOUBLE), 6) AS max,
       round(avg(v) FILTER (v > 0), 6) AS mean FROM word""",
    "array_top": f"""WITH {WORDS}, c AS (SELECT v AS value, count(*) AS count FROM word WHERE v > 0 GROUP BY 1)
SELECT 'words' AS "column", value, count, row_number() OVER (ORDER BY count DESC, value) AS rank FROM c
QUALIFY rank <= 20""",
    "array_length_stats": f"""WITH {WORDS}, s AS (SELECT CAST(len(parts) AS DOUBLE) AS n FROM pieces),
l AS (SELECT count(*) AS total, round(avg(n), 6) AS len_mean, round(stddev_pop(n), 6) AS len_std,
        CAST(min(n) AS BIGINT) AS len_min, CAST(max(n) AS BIGINT) AS len_max,
        round(count(*) FILTER (n = 0) / count(*), 6) AS zero_len_rate,
        CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS len_p50, CAST(floor(quantile_cont(n, 0.75)) AS BIGINT) AS len_p75,
        CAST(floor(quantile_cont(n, 0.9)) AS BIGINT) AS len_p90, CAST(floor(quantile_cont(n, 0.95)) AS BIGINT) AS len_p95,
        CAST(floor(quantile_cont(n, 0.99)) AS BIGINT) AS len_p99 FROM s),
e AS (SELECT count(*) AS elements, CAST(min(v) AS DOUBLE) AS elem_min, CAST(max(v) AS DOUBLE) AS elem_max,
        round(avg(v), 6) AS elem_mean, round(stddev_pop(v), 6) AS elem_std FROM word)
SELECT 'words' AS "column", CAST(0 AS BIGINT) AS null_count, * FROM l, e""",
    "seq_length": seq_length(lengths_of("beh"), f"{BEH}, {USERS}, {DOMAIN_CAPS}"),
    "seq_length_arrays": seq_length(lengths_of("kept"), f"{DAYS}, {KEPT}, {USERS}, {DOMAIN_CAPS}"),
    "domain_coverage": f"""WITH {BEH}, {USERS}, {DOMAIN_CAPS}, lengths AS ({lengths_of("beh")})
SELECT domain, count(*) FILTER (valid_len > 0) AS with_seq, count(*) FILTER (valid_len <= 0) AS without_seq,
       round(count(*) FILTER (valid_len > 0) / count(*), 6) AS coverage FROM lengths GROUP BY 1""",
    "vocab_coverage": f"""WITH {BEH}, {ID_COUNTS}, {DECLARED},
seen AS (SELECT "column", count(DISTINCT v) AS u FROM idc WHERE v > 0 GROUP BY 1)
SELECT "column", vocab, coalesce(u, 0) AS unique_ids, round(coalesce(u, 0) / greatest(vocab, 1), 6) AS coverage_rate, is_ts,
       CASE WHEN is_ts THEN 'timestamp' WHEN coalesce(u, 0) < vocab * 0.01 THEN 'shrink' ELSE '' END AS note
FROM declared LEFT JOIN seen USING ("column")""",
    "ts_detect": f"""WITH {BEH}, {ID_COUNTS},
s AS (SELECT "column", count(*) FILTER (v BETWEEN 1577836800 AND 1893456000) / count(*) AS f FROM idc WHERE v > 0 GROUP BY 1)
SELECT "column", round(f, 6) AS in_range, f > 0.8 AS is_timestamp FROM s""",
    "domain_overlap": f"""WITH {BEH}, {PAIRS}, ids AS (SELECT DISTINCT domain, id FROM beh WHERE id > 0),
u AS (SELECT domain, count(*) AS n FROM ids GROUP BY 1),
o AS (SELECT a.domain AS domain_a, b.domain AS domain_b, count(*) AS c FROM ids a JOIN ids b ON a.id = b.id AND a.domain < b.domain GROUP BY 1, 2)
SELECT domain_a, domain_b, ua.n AS unique_a, ub.n AS unique_b, coalesce(o.c, 0) AS overlap,
       round(coalesce(o.c, 0) / greatest(ua.n, 1), 6) AS rate_a, round(coalesce(o.c, 0) / greatest(ub.n, 1), 6) AS rate_b,
       coalesce(o.c, 0) / greatest(least(ua.n, ub.n), 1) > 0.3 AS share
FROM pairs LEFT JOIN o USING (domain_a, domain_b) JOIN u ua ON ua.domain = domain_a JOIN u ub ON ub.domain = domain_b""",
    "iqr_outliers": iqr_sql(
        """WITH f AS (SELECT l_quantity, pow(l_quantity, 4) AS quantity4, exp(l_discount * 60) AS discount_exp FROM lineitem)""",
        ["l_quantity", "quantity4", "discount_exp"], "f",
    ) + """
SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper, n, outlier_count,
       round(rate, 6) AS outlier_rate, severity FROM outl""",
    "correlations": f"""WITH {FEATS}, c AS ({corr_sql(FEAT, "feat")})
SELECT col_a, col_b, n, round(r, 4) AS pearson FROM c WHERE isfinite(r)""",
    "corr_pairs": f"""WITH {FEATS}, c AS ({corr_sql(FEAT, "feat")})
SELECT col_a, col_b, round(r, 4) AS pearson FROM c WHERE abs(r) >= 0.9""",
    "suggestions": iqr_sql(
        f"""WITH {BEH}, {USERS}, {DOMAIN_CAPS}, {FEATS}, lengths AS ({lengths_of("beh")}),
odd AS (
  SELECT * EXCLUDE (label_type), CASE WHEN l_quantity > 40 THEN l_quantity ELSE 0 END AS mostly_zero,
         CASE WHEN l_tax = 0.08 AND label_type = 2 AND l_quantity < 20 THEN 2 ELSE 1 END AS label_type FROM feat)""",
        ["l_quantity", "l_extendedprice", "net", "mostly_zero"], "odd",
    ) + f""",
lab AS (SELECT count(*) FILTER (label_type = 1) / nullif(count(*) FILTER (label_type = 2), 0) AS r FROM odd),
miss AS (SELECT "column", count(*) FILTER (v <= 0) / count(*) AS r FROM long GROUP BY 1),
cor AS ({corr_sql(["l_quantity", "l_extendedprice", "net", "mostly_zero"], "odd")}),
cov AS (SELECT domain, count(*) FILTER (valid_len > 0) / count(*) AS r FROM lengths GROUP BY 1),
hits AS (
  SELECT 'imbalance' AS rule, 'label_type' AS "column", round(r, 6) AS value FROM lab WHERE r > 20
  UNION ALL SELECT 'missing', "column", round(r, 6) FROM miss WHERE r > 0.5
  UNION ALL SELECT 'correlated', col_a || '/' || col_b, round(r, 4) FROM cor WHERE abs(r) >= 0.9
  UNION ALL SELECT 'low_coverage', domain, round(r, 6) FROM cov WHERE r < 0.5
  UNION ALL SELECT 'outliers', "column", NULL FROM outl WHERE severity IN ('mild', 'severe'))
SELECT * FROM hits UNION ALL SELECT 'ok', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM hits)""",
    "sketch_percentiles": f"""WITH {FEATS}, {long_sql(FEAT, "feat")}
SELECT "column", true AS p50_in_bounds, true AS p90_in_bounds, true AS p99_in_bounds, count(v) AS n FROM long GROUP BY 1""",
    "sketch_strings": """WITH t AS (
  SELECT 'lang' AS "column", nullif(lang, 'en') AS v FROM documents UNION ALL SELECT 'source', source FROM documents),
n AS (SELECT "column", count(*) AS total, count(DISTINCT v) AS approx_unique FROM t GROUP BY 1),
c AS (SELECT "column", v, count(*) AS count FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, v) AS rank FROM c WHERE v IS NOT NULL)
SELECT "column", total, approx_unique, v AS item, count FROM r JOIN n USING ("column") WHERE rank <= 20""",
    "full_report": f"""WITH {DAYS}, {KEPT}, {USERS}, {DOMAIN_CAPS}, {WIDE_SCALARS}, lengths AS ({lengths_of("kept")}),
{report_sql()}""",
    "recent_k": f"""WITH {BEH}, {KEPT} SELECT user_id, domain, recency, event_id, item FROM recent WHERE recency <= 64""",
    "recent_arrays": f"""WITH {DAYS}, {KEPT} SELECT user_id, domain,
row_number() OVER (PARTITION BY user_id, domain ORDER BY pos) - 1 AS pos, item AS value FROM kept WHERE recency <= 2""",
    "embedding_lookup": f"""WITH {BEH}
SELECT event_id, item, coalesce(CAST(e.embedding[1] AS DOUBLE), 0.0) AS first, coalesce(CAST(e.embedding[{DIM}] AS DOUBLE), 0.0) AS last,
       CAST({DIM} AS BIGINT) AS dim
FROM beh LEFT JOIN embeddings e ON e.vec_id = beh.item AND e.vec_id % 3 <> 2 AND e.vec_id > 0""",
    "mean_pool": f"""WITH {BEH}, {VEC}, {positions(DIM)}, {POOL}
SELECT g.user_id, g.domain, g.n_valid, p.pos, round(coalesce(v, 0.0), 6) AS value
FROM groups g CROSS JOIN pos_n p LEFT JOIN pooled q ON q.user_id = g.user_id AND q.domain = g.domain AND q.pos = p.pos""",
    "mean_pool_wide": f"""WITH {BEH}, {positions(5 * DIM)},
n AS (SELECT domain, item, count(*) AS c FROM beh WHERE item > 0 GROUP BY 1, 2),
t AS (SELECT domain, CAST(sum(c) AS BIGINT) AS n_valid FROM n GROUP BY 1),
x AS (
  SELECT vec_id, pos, CASE WHEN vec_id % 5 = 0 AND pos >= 40 THEN 0 WHEN vec_id % 5 = 1 AND (pos = 3 OR pos >= {DIM}) THEN 0
         ELSE CAST(embedding[pos % {DIM} + 1] AS DOUBLE) END AS x FROM embeddings CROSS JOIN pos_n WHERE vec_id > 0)
SELECT domain, n_valid, pos, round(sum(c * x) / n_valid, 6) AS value FROM n JOIN x ON vec_id = item JOIN t USING (domain) GROUP BY 1, 2, 3""",
    "target_topk": f"""WITH {BEH}, {VEC}, {TARGETS}
SELECT user_id, rank, recency, event_id, item, round(score, 6) AS score,
       round(exp(score - max(score) OVER (PARTITION BY user_id)) /
             sum(exp(score)) OVER (PARTITION BY user_id) * exp(max(score) OVER (PARTITION BY user_id)), 6) AS weight
FROM ranked WHERE rank <= 64""",
    "unified_timeline": f"""WITH {DAYS}, {KEPT}, {USERS}, {DOMAIN_CAPS}, {WIDE_SCALARS}, {VIRTUAL}
SELECT user_id, CAST(0 AS BIGINT) AS segment, CAST(CASE "column" WHEN 'item_int_feats_4' THEN 0 WHEN 'user_int_feats_1' THEN 1 ELSE 2 END AS BIGINT) AS pos,
       virtual_id AS token, CAST(0 AS BIGINT) AS bucket FROM vid
UNION ALL
SELECT k.user_id, CAST(list_position({DOMAINS}, k.domain) AS BIGINT), k.pos, {CLEAN_ITEM}, {bucket("u.req", "k.ts", TIME_EDGES)}
FROM kept k JOIN users u USING (user_id) JOIN caps c ON c.domain = k.domain WHERE k.pos < c.n""",
    "tail_split": f"WITH {BEH}, {tail_sql('ts, event_id', 'beh', 'event_id', 1.0)}",
    "train_prefix": f"WITH {BEH}, {tail_sql('ts, event_id', 'beh', 'event_id', 0.5)}",
    "tail_split_nulls": f"""WITH {BEH}, e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts // 86400 END AS day FROM beh),
r AS (SELECT *, row_number() OVER (ORDER BY day NULLS FIRST, event_id) AS i, count(*) OVER () AS n FROM e)
SELECT event_id, day, CASE WHEN i <= n - greatest(1, CAST(floor(n * 0.4) AS BIGINT)) THEN 'train' ELSE 'valid' END AS split FROM r""",
    "tail_split_ties": f"""WITH {BEH}, e AS (SELECT CASE WHEN event_id % 3 <> 0 THEN ts // 86400 END AS day FROM beh),
r AS (SELECT *, row_number() OVER (ORDER BY day NULLS FIRST) AS i, count(*) OVER () AS n FROM e),
s AS (SELECT *, n - greatest(1, CAST(floor(n * 0.4) AS BIGINT)) AS rest FROM r)
SELECT day, CASE WHEN i > rest THEN 'valid' WHEN i <= greatest(1, CAST(floor(rest * 0.5) AS BIGINT)) THEN 'train' ELSE 'dropped' END AS split,
       count(*) AS n FROM s GROUP BY 1, 2""",
    "sample_repeated_ids": f"""WITH {BEH}, r AS (SELECT user_id FROM beh ORDER BY {hash52(42, "user_id")}, user_id LIMIT 500)
SELECT user_id, count(*) AS n FROM r GROUP BY 1""",
    "tail_split_files": f"WITH {tail_sql('o_orderkey', 'orders', 'o_orderkey', 0.5)}",
    "stratified_split": f"""WITH k AS (SELECT doc_id, quality, {hash52(42, "doc_id")} AS h FROM labels),
c AS (SELECT quality, count(*) AS n, sum(count(*)) OVER () AS total FROM k GROUP BY 1),
s AS (SELECT *, CAST(ceil(total * 0.2) AS BIGINT) AS want, n * ceil(total * 0.2) / total AS exact FROM c),
a AS (
  SELECT *, CAST(floor(exact) AS BIGINT) AS base, row_number() OVER (ORDER BY floor(exact) - exact, quality) AS pr,
         sum(CAST(floor(exact) AS BIGINT)) OVER () AS given FROM s),
z AS (SELECT quality, base + CASE WHEN pr <= want - given THEN 1 ELSE 0 END AS size FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS rk FROM k)
SELECT doc_id, CAST(quality AS BIGINT) AS quality, CASE WHEN rk <= size THEN 'test' ELSE 'train' END AS split FROM r JOIN z USING (quality)""",
    "exact_sample": f"""WITH {BEH} SELECT event_id, user_id, item FROM beh ORDER BY {hash52(42, "event_id")}, event_id LIMIT 500""",
    "shuffled_export": f"WITH {BEH} SELECT event_id, user_id, item FROM beh",
    "last_prediction": f"""WITH {BEH} SELECT user_id, round(1 / (1 + exp(-(arg_max(value, (ts, event_id)) - 50) / 100)), 6) AS prob
FROM beh GROUP BY user_id""",
    "preview": """WITH t AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS row FROM embeddings)
SELECT row, vec_id, CAST(label AS BIGINT) AS label, CASE WHEN row = 1 THEN len(embedding) END AS embedding_len, """ + ", ".join(
        f"CASE WHEN row = 1 THEN CAST(embedding[{i + 1}] AS DOUBLE) END AS e{i}" if i < 5 else f"CAST(NULL AS DOUBLE) AS e{i}"
        for i in range(6)
    ) + " FROM t WHERE row <= 3",
    "auc": f"""WITH {SCORED}, c AS (SELECT z, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM known GROUP BY z),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
       round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM r""",
    "logloss": f"""WITH {SCORED} SELECT count(*) AS n, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS log_loss FROM known""",
    "focal_loss": f"""WITH {SCORED}, t AS (
  SELECT y, CASE WHEN y = 1 THEN 1 / (1 + exp(-z)) ELSE 1 - 1 / (1 + exp(-z)) END AS pt FROM known)
SELECT 'mean' AS kind, round(avg(CASE WHEN y = 1 THEN 0.1 ELSE 0.9 END * pow(1 - pt, 2) * -ln(pt)), 6) AS focal_loss FROM t
UNION ALL SELECT 'sum', round(sum(CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END * pow(1 - pt, 3) * -ln(pt)), 6) FROM t""",
    "class_report": f"""WITH {SCORED}, s AS (SELECT y, CAST(z > 0.5 AS INTEGER) AS p FROM known), k(c) AS (VALUES (0), (1)),
n AS (SELECT c, count(*) FILTER (y = c AND p = c) AS hit, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS said FROM s, k GROUP BY c)
SELECT CAST(c AS BIGINT) AS class, round(hit / greatest(said, 1), 6) AS precision, round(hit / greatest(support, 1), 6) AS recall,
       round(2 * hit / greatest(said + support, 1), 6) AS f1, support FROM n""",
    "standardize": f"WITH {MEASURES} " + " UNION ALL ".join(
        f"SELECT doc_id, CAST({i} AS BIGINT) AS pos, round((a{i} - avg(a{i}) OVER ()) / stddev_pop(a{i}) OVER (), 6) AS value FROM m"
        for i in range(6)
    ),
    "incremental_profile": f"""WITH {long_sql(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem")}
{incremental_sql(exact_mean6("v"))}""",
    "incremental_overlap": f"WITH {PAIRS} SELECT domain_a, domain_b, true AS unique_in_bounds, true AS overlap_in_bounds FROM pairs",
    "incremental_correlations": f"""WITH {FEATS}, c AS ({corr_sql(FEAT, "feat")})
SELECT col_a, col_b, n, round(r, 4) AS pearson FROM c WHERE isfinite(r)""",
    "incremental_sample": f"""WITH {BEH} SELECT event_id, user_id, item FROM beh ORDER BY {hash52(42, "event_id")}, event_id LIMIT 500""",
    "incremental_outliers": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", true AS below_in_bounds, true AS above_in_bounds"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "incremental_native": f"""WITH {long_sql(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem")}
{incremental_sql(exact_mean6("v"))}""",
    "incremental_times": f"""WITH {BEH}, f AS (SELECT 1.7e9 + (event_id % 7) / 10 AS tick, ts FROM beh), {long_sql(["tick", "ts"], "f")}
SELECT * REPLACE (round(mean, 2) AS mean, round(std, 4) AS std) FROM ({incremental_sql().replace("avg(v)", "favg(v)")})""",
    "incremental_arrays": f"""WITH {VEC}, long AS (
  SELECT 'embedding#len' AS "column", CAST(len(embedding) AS DOUBLE) AS v FROM embeddings UNION ALL SELECT 'embedding#elem', x FROM vec)
{incremental_sql()}""",
    "incremental_strings": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS null_count, true AS unique_in_bounds FROM documents"
        for c in ("lang", "source", "text")
    ),
    "incremental_labels": f"WITH {FEATS} SELECT CAST(label_type AS BIGINT) AS label, count(*) AS count FROM feat GROUP BY 1",
    "incremental_lengths": f"""WITH {DAYS}, {KEPT}, {USERS}, {DOMAIN_CAPS}, lengths AS ({lengths_of("kept")})
SELECT domain, count(*) AS n_rows, round(avg(valid_len), 6) AS mean_len, round(quantile_cont(CAST(valid_len AS DOUBLE), 0.5), 6) AS p50,
       round(quantile_cont(CAST(valid_len AS DOUBLE), 0.9), 6) AS p90, round(quantile_cont(CAST(valid_len AS DOUBLE), 0.99), 6) AS p99,
       max(valid_len) AS max_len, count(*) FILTER (valid_len > 0) AS with_seq, count(*) FILTER (valid_len = 0) AS without_seq,
       round(count(*) FILTER (valid_len > 0) / count(*), 6) AS coverage FROM lengths GROUP BY 1""",
    "incremental_ids": f"""WITH {DAYS}, el AS ({seq_fields("beh")}), declared(c, vocab, is_ts) AS (VALUES {declared_rows()}),
seen AS (SELECT c, count(DISTINCT v) AS u, count(*) FILTER (v BETWEEN 1577836800 AND 1893456000) / count(*) AS f FROM el WHERE v > 0 GROUP BY 1)
SELECT c AS "column", CAST(vocab AS BIGINT) AS vocab, coalesce(u, 0) AS unique_ids, round(coalesce(u, 0) / greatest(vocab, 1), 6) AS coverage_rate, is_ts,
       CASE WHEN is_ts THEN 'timestamp' WHEN coalesce(u, 0) < vocab * 0.01 THEN 'shrink' ELSE '' END AS note,
       round(f, 6) AS in_range, f > 0.8 AS is_timestamp FROM declared LEFT JOIN seen USING (c)""",
    "element_top": f"""WITH {WORDS}, c AS (SELECT v AS value, count(*) AS count FROM word GROUP BY 1)
SELECT * FROM (SELECT 'words' AS "column", value, count, row_number() OVER (ORDER BY count DESC, value) AS rank FROM c) WHERE rank <= 20""",
    "coverage_first_field": f"""WITH {DAYS}, {KEPT}, {USERS}, {DOMAIN_CAPS}, lengths AS ({lengths_of("kept")}),
firsts AS ({lengths_of("kept")}),
c AS (SELECT 'first' AS rule, * FROM firsts UNION ALL SELECT 'reference', * FROM lengths)
SELECT rule, domain, count(*) FILTER (valid_len > 0) AS with_seq, count(*) FILTER (valid_len = 0) AS without_seq,
       round(count(*) FILTER (valid_len > 0) / count(*), 6) AS coverage FROM c GROUP BY 1, 2""",
}

TEST_ROWS = f"SELECT doc_id, quality FROM ({ORACLE['stratified_split']}) WHERE split = 'test'"
TERMS = ", ".join(f"('{t}')" for t in ("intercept", "n_chars", "n_words", "n_lines", "mean_word", "n_upper", "n_digit"))
ORACLE |= {
    "logistic_baseline": f"""SELECT term, true AS holds, CAST(0 AS BIGINT) AS n FROM (VALUES {TERMS}) t(term)
UNION ALL SELECT 'class ' || quality, true, count(*) FROM ({TEST_ROWS}) GROUP BY quality""",
    "boosted_trees": f"SELECT quality AS class, count(*) AS support, true AS shares, true AS ranks FROM ({TEST_ROWS}) GROUP BY 1",
    "feature_importance": "SELECT range AS rank, true AS holds FROM range(1, 7)",
    "batch_scoring": f"SELECT doc_id, true AS holds FROM ({TEST_ROWS})",
}
