"""Shared table expressions of the checking SQL (DuckDB dialect).

Written apart from the Spark code and from the definitions alone, so that agreement of
the two means something. ``{b}`` names come in two kinds: ``_app`` and ``_com``.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def split_sql(entity: str, train: float = 0.8, val: float = 0.1, seed: int = 20260101) -> str:
    place = f"('0x' || substr(sha256('{seed}:' || {entity}), 1, 8))::BIGINT / 4294967295::DOUBLE"
    return (
        f"CASE WHEN {place} < {train}::DOUBLE THEN 'train' "
        f"WHEN {place} < ({train}::DOUBLE + {val}::DOUBLE) THEN 'val' ELSE 'test' END"
    )


def uniform_sql(text: str, word: int = 0) -> str:
    return f"('0x' || substr(sha256({text}), {1 + 8 * word}, 8))::BIGINT / 4294967296::DOUBLE"


def softlog_sql(seconds: str) -> str:
    return f"8.0::DOUBLE * ln(1 + ({seconds}) / 8.0::DOUBLE)"


def secs_sql(earlier: str, later: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1e6::DOUBLE)"


def tree_sql(source: str) -> str:
    """Fingerprint of the ids of a source: hashes of sorted items, folded from four digits to none."""
    levels = [f"t4 AS (SELECT substr(sha256(entity_id), 1, 4) AS place, sha256(string_agg(entity_id, '|' ORDER BY entity_id)) AS item FROM {source} GROUP BY 1)"]
    for width in (3, 2, 1, 0):
        levels.append(
            f"t{width} AS (SELECT substr(place, 1, {width}) AS place, sha256(string_agg(item, '|' ORDER BY item)) AS item FROM t{width + 1} GROUP BY 1)"
        )
    return f"WITH {', '.join(levels)} SELECT item AS fingerprint FROM t0"


def median_sql(source: str, by: str, value: str, fraction: str = "0.5") -> str:
    """``(by, q)`` exact quantile with interpolation, from ranks."""
    return f"""
    SELECT {by}, CASE WHEN max(t) < 0.5 THEN max(lo) + (max(hi) - max(lo)) * max(t)
                 ELSE max(hi) - (max(hi) - max(lo)) * (1 - max(t)) END AS q
    FROM (
      SELECT {by}, {fraction}::DOUBLE * (n - 1) - floor({fraction}::DOUBLE * (n - 1)) AS t,
             CASE WHEN rn = floor({fraction}::DOUBLE * (n - 1)) THEN v END AS lo,
             CASE WHEN rn = least(floor({fraction}::DOUBLE * (n - 1)) + 1, n - 1) THEN v END AS hi
      FROM (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS rn,
                   count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {value} IS NOT NULL)
    ) GROUP BY {by}"""


CTES["ev_app"] = """
  SELECT user_id::VARCHAR AS entity_id, lpad(event_id::VARCHAR, 20, '0') AS event_id, ts AS created_at,
         event_type AS type, value AS amount, json_extract_string(props, '$.k') AS view
  FROM events"""

CTES["ev_com"] = """
  SELECT o_custkey::VARCHAR AS entity_id, 'o' || lpad(o_orderkey::VARCHAR, 20, '0') AS event_id,
         o_orderdate AS created_at, 'order' AS type, o_totalprice AS amount, NULL::DOUBLE AS discount,
         o_orderstatus AS direction, o_orderpriority AS channel, NULL::VARCHAR AS mcc,
         NULL::VARCHAR AS merchant_name, NULL::VARCHAR AS description
  FROM orders
  UNION ALL
  SELECT o_custkey::VARCHAR,
         'l' || lpad(l_orderkey::VARCHAR, 20, '0') || '-' || lpad(l_linenumber::VARCHAR, 20, '0') || '-'
             || lpad(l_partkey::VARCHAR, 20, '0') || '-' || lpad(l_suppkey::VARCHAR, 20, '0') || '-'
             || strftime(l_shipdate, '%Y%m%d') || '-'
             || lpad(l_extendedprice::DECIMAL(18,2)::VARCHAR, 21, '0'),
         l_shipdate, 'line', l_extendedprice, l_discount, l_returnflag, NULL, p_brand, s_name, p_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey"""

CTES["prof"] = """
  SELECT c_custkey::VARCHAR AS entity_id, n_name AS country, c_mktsegment AS plan,
         'q' || ntile(5) OVER (ORDER BY c_acctbal, c_custkey) AS balance_quantile,
         coalesce(first_order_at, first_event_at, TIMESTAMP '1992-01-01') AS signup_at,
         first_purchase_at, first_view_at
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order_at FROM orders GROUP BY 1) o
         ON o.o_custkey = c_custkey
  LEFT JOIN (SELECT user_id, min(ts) AS first_event_at,
                    min(ts) FILTER (WHERE event_type = 'purchase') AS first_purchase_at,
                    min(ts) FILTER (WHERE event_type = 'view') AS first_view_at
             FROM events GROUP BY 1) e ON e.user_id = c_custkey"""

KEYS = {
    "app": ("amount", "balance_quantile", "country", "first_purchase_at", "first_view_at", "plan",
            "signup_at", "type", "view"),
    "com": ("amount", "balance_quantile", "channel", "country", "direction", "discount",
            "first_purchase_at", "first_view_at", "mcc", "plan", "signup_at", "type"),
}
# Value columns in declaration order: (column, is a number).
FIELDS = {
    "app": (("amount", True), ("view", False)),
    "com": (("amount", True), ("discount", True), ("direction", False), ("channel", False),
            ("mcc", False), ("merchant_name", False), ("description", False)),
}
# Category keys in declaration order, profile keys last.
CATEGORIES = {
    "app": ("type", "view", "country", "plan", "balance_quantile"),
    "com": ("type", "direction", "channel", "mcc", "country", "plan", "balance_quantile"),
}
IGNORED = ("merchant_name", "description")

for b in ("app", "com"):
    names = ", ".join(f"('{k}')" for k in KEYS[b])
    CTES[f"keyids_{b}"] = f"""
  SELECT key, 6 + row_number() OVER (ORDER BY key) AS key_id FROM (VALUES {names}) t(key)"""

    CTES[f"hist_{b}"] = f"""
  SELECT * FROM ev_{b} WHERE entity_id IN (SELECT entity_id FROM prof)"""

    CTES[f"rec_{b}"] = f"""
  SELECT entity_id, {split_sql('entity_id')} AS split, evaluation_time, n_events,
         country, plan, balance_quantile,
         CASE WHEN signup_at <= evaluation_time THEN signup_at END AS signup_at,
         CASE WHEN first_purchase_at <= evaluation_time THEN first_purchase_at END AS first_purchase_at,
         CASE WHEN first_view_at <= evaluation_time THEN first_view_at END AS first_view_at
  FROM (SELECT p.*, coalesce(latest, signup_at) AS evaluation_time, coalesce(n, 0) AS n_events
        FROM prof p LEFT JOIN (SELECT entity_id, max(created_at) AS latest, count(*) AS n
                               FROM ev_{b} GROUP BY 1) e USING (entity_id))"""

    CTES[f"long_{b}"] = " UNION ALL ".join(
        f"""
  SELECT entity_id, event_id, created_at, type, {i} AS field_ord, '{k}' AS key,
         {k if number else 'NULL'}::DOUBLE AS num, {'NULL' if number else k}::VARCHAR AS txt
  FROM hist_{b} WHERE {k} IS NOT NULL"""
        for i, (k, number) in enumerate(FIELDS[b])
    )

    CTES[f"nonzero_{b}"] = f"""
  SELECT key, num, row_number() OVER (PARTITION BY key ORDER BY num) - 1 AS rn,
         count(*) OVER (PARTITION BY key) AS n
  FROM long_{b} WHERE num IS NOT NULL AND num <> 0 AND {split_sql('entity_id')} = 'train'"""

    CTES[f"bounds_{b}"] = f"""
  SELECT key, bound, row_number() OVER (PARTITION BY key ORDER BY bound) - 1 AS idx
  FROM (SELECT DISTINCT e.key, CASE WHEN t < 0.5 THEN lo.num + (hi.num - lo.num) * t
                                    ELSE hi.num - (hi.num - lo.num) * (1 - t) END AS bound
        FROM (SELECT key, n, floor(spot) AS low, least(floor(spot) + 1, n - 1) AS high, spot - floor(spot) AS t
              FROM (SELECT DISTINCT key, n, (i / 16::DOUBLE) * (n - 1) AS spot
                    FROM nonzero_{b}, (SELECT unnest(range(1, 16)) AS i))) e
        JOIN nonzero_{b} lo ON lo.key = e.key AND lo.rn = e.low
        JOIN nonzero_{b} hi ON hi.key = e.key AND hi.rn = e.high)"""

    ords = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(CATEGORIES[b]))
    CTES[f"cats_{b}"] = f"""
  SELECT key, txt AS value,
         6 + {len(KEYS[b])} + 17 + row_number() OVER (ORDER BY CASE key {ords} END, txt) AS value_id
  FROM (SELECT DISTINCT key, txt FROM long_{b}
        WHERE txt IS NOT NULL AND key NOT IN {IGNORED} AND {split_sql('entity_id')} = 'train')"""

    CTES[f"capped_{b}"] = f"""
  SELECT *, max(created_at) OVER (PARTITION BY entity_id) AS latest_at,
         count(*) OVER (PARTITION BY entity_id) - age_rank AS event_ord
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, event_id DESC) AS age_rank
        FROM hist_{b}) WHERE age_rank <= 6500"""

    CTES[f"fieldtok_{b}"] = f"""
  SELECT l.entity_id, l.event_id, l.field_ord, l.key, k.key_id,
         CASE WHEN l.num IS NOT NULL THEN
                CASE WHEN l.num = 0 THEN 7 + {len(KEYS[b])}
                     ELSE 8 + {len(KEYS[b])} + least(len(list_filter(bl.bounds, lambda x: x <= l.num)), 15) END
              ELSE coalesce(c.value_id, 1) END AS value_id
  FROM long_{b} l JOIN keyids_{b} k ON k.key = l.key
  LEFT JOIN (SELECT key, list(bound ORDER BY bound) AS bounds FROM bounds_{b} GROUP BY key) bl ON bl.key = l.key
  LEFT JOIN cats_{b} c ON c.key = l.key AND c.value = l.txt"""

    CTES[f"tok_{b}"] = f"""
  SELECT f.entity_id, f.event_id, e.event_ord, e.created_at, e.latest_at, f.key, f.key_id, f.value_id,
         row_number() OVER (PARTITION BY f.event_id ORDER BY f.field_ord) - 1 AS tok_ord
  FROM fieldtok_{b} f JOIN capped_{b} e ON e.event_id = f.event_id"""

    CTES[f"proftok_{b}"] = f"""
  SELECT entity_id, split, key, key_id, value_id, time_coord,
         row_number() OVER (PARTITION BY entity_id ORDER BY key) - 1 AS tok_ord
  FROM (
    SELECT entity_id, split, key, 1 AS value_id, 0.0::DOUBLE AS time_coord
    FROM (SELECT entity_id, split, unnest(['country', 'plan', 'balance_quantile']) AS key,
                 unnest([country, plan, balance_quantile]) AS v FROM rec_{b} WHERE n_events > 0)
    WHERE v IS NOT NULL
    UNION ALL
    SELECT entity_id, split, key, CASE WHEN when_at IS NULL THEN 6 ELSE 5 END,
           CASE WHEN when_at IS NULL THEN 0.0::DOUBLE ELSE {softlog_sql(secs_sql('when_at', 'evaluation_time'))} END
    FROM (SELECT entity_id, split, evaluation_time,
                 unnest(['signup_at', 'first_purchase_at', 'first_view_at']) AS key,
                 unnest([signup_at, first_purchase_at, first_view_at]) AS when_at
          FROM rec_{b} WHERE n_events > 0)
  ) JOIN keyids_{b} USING (key)"""

    CTES[f"sizes_{b}"] = f"""
  SELECT r.entity_id, r.split, r.n_events AS n_events_total, e.n AS n_events,
         coalesce(t.n, 0) AS n_event_tokens, coalesce(t.n, 0) + p.n AS n_value_tokens,
         CASE WHEN e.n < 1 THEN '0-0' WHEN e.n < 50 THEN '1-49' WHEN e.n < 500 THEN '50-499'
              ELSE '500+' END AS length_bucket
  FROM rec_{b} r
  JOIN (SELECT entity_id, count(*) AS n FROM capped_{b} GROUP BY 1) e USING (entity_id)
  LEFT JOIN (SELECT entity_id, count(*) AS n FROM tok_{b} GROUP BY 1) t USING (entity_id)
  JOIN (SELECT entity_id, count(*) AS n FROM proftok_{b} GROUP BY 1) p USING (entity_id)"""

    maskable = ", ".join(
        f"'{k}'" for k in KEYS[b] if not k.endswith("_at")
    )
    base = "'20260101|{e}|' || entity_id || '|"
    for epoch in (0, 1):
        pre = f"'20260101|{epoch}|' || entity_id || '|"
        token = f"{pre}token|' || event_id || '|' || tok_ord"
        CTES[f"mask{epoch}_{b}"] = f"""
  SELECT *, CASE WHEN origin = 0 THEN value_id WHEN dropped THEN 1 ELSE 2 END AS input_id,
         CASE WHEN origin <> 0 AND NOT dropped THEN value_id ELSE -100 END AS label
  FROM (SELECT *, origin <> 0 AND {uniform_sql(token, 1)} < 0.05::DOUBLE AS dropped
        FROM (SELECT *, CASE WHEN eligible AND {uniform_sql(token)} < 0.15::DOUBLE THEN 1 ELSE 0 END
                     + CASE WHEN eligible AND {uniform_sql(pre + "event|' || event_id")} < 0.1::DOUBLE THEN 2 ELSE 0 END
                     + CASE WHEN eligible AND {uniform_sql(pre + "key|' || key_id")} < 0.1::DOUBLE THEN 4 ELSE 0 END AS origin
              FROM (SELECT *, key IN ({maskable}) AND value_id <> 1 AS eligible FROM tok_{b})))"""

    CTES[f"bucketed_{b}"] = f"""
  SELECT *, ((row_number() OVER (ORDER BY n_event_tokens, entity_id) - 1)
             // ceil(count(*) OVER () / least(8, count(*) OVER ()))::BIGINT)::BIGINT AS bucket
  FROM sizes_{b}"""

    CTES[f"seq_{b}"] = f"""
  SELECT s.*, bo.bucket_pos, row_number() OVER (PARTITION BY s.bucket
             ORDER BY sha256('0|0|record|' || entity_id), entity_id) AS rn
  FROM bucketed_{b} s
  JOIN (SELECT b AS bucket, row_number() OVER (ORDER BY sha256('0|0|bucket|' || b)) AS bucket_pos
        FROM (SELECT unnest(range(0, 8)) AS b)) bo ON bo.bucket = s.bucket"""

    over = "p.t + s.n_event_tokens > 4096 OR p.e + s.n_events > 2048 OR p.r + 1 > 256"
    CTES[f"order_{b}"] = f"""
  SELECT *, row_number() OVER (ORDER BY bucket_pos, rn) AS g FROM seq_{b}"""

    CTES[f"pack_{b}"] = f"""
  SELECT entity_id, bucket, g, n_events, n_event_tokens, 0::BIGINT AS batch_id,
         n_event_tokens AS t, n_events AS e, 1::BIGINT AS r
  FROM order_{b} WHERE g = 1
  UNION ALL
  SELECT s.entity_id, s.bucket, s.g, s.n_events, s.n_event_tokens,
         CASE WHEN {over} THEN p.batch_id + 1 ELSE p.batch_id END,
         CASE WHEN {over} THEN s.n_event_tokens ELSE p.t + s.n_event_tokens END,
         CASE WHEN {over} THEN s.n_events ELSE p.e + s.n_events END,
         CASE WHEN {over} THEN 1 ELSE p.r + 1 END
  FROM pack_{b} p JOIN order_{b} s ON s.g = p.g + 1"""

    CTES[f"batches_{b}"] = f"""
  SELECT entity_id, n_events, n_event_tokens, bucket, batch_id, r - 1 AS pos FROM pack_{b}"""

    CTES[f"totals_{b}"] = f"""
  SELECT p.entity_id, coalesce(sum(amount::DECIMAL(38,9))::DOUBLE, 0.0) AS total
  FROM prof p LEFT JOIN ev_{b} e USING (entity_id) GROUP BY 1"""

    CTES[f"high_{b}"] = f"""
  SELECT entity_id, total, total > (SELECT quantile_cont(total, 0.5) FROM totals_{b}) AS is_high_value
  FROM totals_{b}"""

    CTES[f"escal_{b}"] = f"""
  SELECT p.entity_id, coalesce(n >= 4 AND coalesce(second, 0) > coalesce(first, 0), false) AS is_escalating
  FROM prof p LEFT JOIN (
    SELECT entity_id, max(n) AS n, sum(amount::DECIMAL(38,9)) FILTER (WHERE rn > n // 2) AS second,
           sum(amount::DECIMAL(38,9)) FILTER (WHERE rn <= n // 2) AS first
    FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, event_id) AS rn,
                 count(*) OVER (PARTITION BY entity_id) AS n FROM ev_{b}) GROUP BY 1) h USING (entity_id)"""

    CTES[f"feat_{b}"] = f"""
  SELECT r.entity_id, r.split, coalesce(n, 0) AS n_events, coalesce(n_types, 0) AS n_distinct_event_types,
         coalesce(total, 0.0) AS total_amount,
         CASE WHEN coalesce(n_amounts, 0) > 0 THEN total / n_amounts ELSE 0.0 END AS mean_amount,
         {secs_sql('signup_at', 'evaluation_time')} / 86400::DOUBLE AS days_since_signup,
         first_purchase_at IS NOT NULL AS has_first_purchase_at, first_view_at IS NOT NULL AS has_first_view_at,
         country, plan, balance_quantile
  FROM rec_{b} r LEFT JOIN (
    SELECT entity_id, count(*) AS n, count(DISTINCT type) AS n_types,
           sum(amount::DECIMAL(38,9))::DOUBLE AS total, count(amount) AS n_amounts
    FROM ev_{b} GROUP BY 1) e USING (entity_id)"""

    CTES[f"cohort_{b}"] = f"""
  SELECT p.entity_id, coalesce(n, 0) AS n_events,
         CASE WHEN n IS NULL THEN 'zero_events' WHEN n = 1 THEN 'single_event' WHEN n >= 60 THEN 'long_history'
              WHEN lo = hi THEN 'same_timestamp' ELSE 'normal' END AS cohort
  FROM prof p LEFT JOIN (SELECT entity_id, count(*) AS n, min(created_at) AS lo, max(created_at) AS hi
                         FROM ev_{b} GROUP BY 1) e USING (entity_id)"""

# Text fields. Pieces are written as the hex of their bytes between commas, so a pair that spells a
# known piece is that piece; ids are places in the list of names, after the unknown piece.
CTES["txts_com"] = f"""
  SELECT txt, sum(train)::BIGINT AS n
  FROM (SELECT unnest([merchant_name, description]) AS txt, ({split_sql('entity_id')} = 'train')::INT AS train FROM hist_com)
  WHERE txt IS NOT NULL GROUP BY 1"""

CTES["cut_com"] = r"""
  SELECT txt, n, regexp_extract_all(txt, $$'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+$$) AS ws FROM txts_com"""

CTES["wrds_com"] = r"""
  SELECT list(word ORDER BY word) AS ws, list(n ORDER BY word) AS ns,
         list(regexp_replace(lower(hex(encode(word))), '(..)', ',\1,', 'g') ORDER BY word) AS ps
  FROM (SELECT word, sum(n)::BIGINT AS n FROM (SELECT unnest(ws) AS word, n FROM cut_com) GROUP BY 1)"""

CTES["abc_com"] = """
  SELECT list(printf('%02x', b) ORDER BY shown DESC, b) AS names
  FROM (SELECT b, (b BETWEEN 33 AND 126) OR (b BETWEEN 161 AND 172) OR b >= 174 AS shown FROM (SELECT unnest(range(256)) AS b))"""

CTES["bpe_com"] = """
  SELECT 0 AS step, names, ps, ns, NULL::VARCHAR AS l, NULL::VARCHAR AS r FROM wrds_com, abc_com
  UNION ALL
  SELECT step + 1, CASE WHEN list_contains(names, x || y) THEN names ELSE list_append(names, x || y) END,
         list_transform(ps, lambda p: replace(p, ',' || x || ',,' || y || ',', ',' || x || y || ',')), ns, x, y
  FROM (SELECT *, best.l AS x, best.r AS y FROM (
    SELECT s.step, s.names, s.ps, s.ns, (
      SELECT arg_min({'l': l, 'r': r}, [-n, list_position(s.names, l), list_position(s.names, r)])
      FROM (SELECT l, r, sum(n)::BIGINT AS n FROM (
              SELECT q[i] AS l, q[i + 1] AS r, n FROM (
                SELECT q, n, unnest(range(1, len(q))) AS i FROM (
                  SELECT string_split(substr(p, 2, length(p) - 2), ',,') AS q, n
                  FROM (SELECT unnest(s.ps) AS p, unnest(s.ns) AS n))))
            GROUP BY l, r HAVING sum(n) > 0)) AS best
    FROM bpe_com s WHERE len(s.names) < 511) WHERE best IS NOT NULL)"""

CTES["spelt_com"] = """
  SELECT word, list_transform(string_split(substr(p, 2, length(p) - 2), ',,'), lambda h: list_position(names, h)) AS ids
  FROM (SELECT unnest(ws) AS word, unnest(f.ps) AS p, f.names
        FROM wrds_com, (SELECT ps, names FROM bpe_com ORDER BY step DESC LIMIT 1) f)"""

CTES["txtids_com"] = """
  SELECT txt, list_slice(flatten(list(ids ORDER BY place)), 1, 8) AS ids
  FROM (SELECT txt, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM cut_com) JOIN spelt_com USING (word) GROUP BY 1"""

CTES["keyidx_com"] = f"""
  SELECT key, 6 + row_number() OVER (ORDER BY key) AS key_id
  FROM (SELECT unnest({[*KEYS['com'], *IGNORED]}) AS key)"""

# All tokens with the text fields in: two more keys move the other value ids up by two.
CTES["fieldtxt_com"] = f"""
  SELECT entity_id, event_id, field_ord, key, k.key_id, 0 AS pos, CASE WHEN value_id = 1 THEN 1 ELSE value_id + 2 END AS value_id
  FROM fieldtok_com JOIN keyidx_com k USING (key)
  UNION ALL
  SELECT entity_id, event_id, field_ord, key, key_id, unnest(range(len(ids))), unnest(ids) + base
  FROM (SELECT l.*, t.ids, k.key_id, 7 + {len(KEYS['com']) + 2} + 17 + (SELECT count(*) FROM cats_com) AS base
        FROM long_com l JOIN txtids_com t ON t.txt = l.txt JOIN keyidx_com k ON k.key = l.key WHERE l.key IN {IGNORED})"""

CTES["toktxt_com"] = """
  SELECT f.*, e.event_ord, count(*) OVER (PARTITION BY f.event_id, f.field_ord) AS n_field,
         count(*) OVER (PARTITION BY f.event_id ORDER BY f.field_ord) AS upto,
         row_number() OVER (PARTITION BY f.event_id ORDER BY f.field_ord, f.pos) - 1 AS tok_ord
  FROM fieldtxt_com f JOIN capped_com e ON e.event_id = f.event_id"""

CTES["vec"] = f"""
  SELECT vec_id::VARCHAR AS entity_id, embedding, label = 0 AS label, {split_sql('vec_id::VARCHAR')} AS split
  FROM embeddings"""

RECURSIVE = re.compile(r"^(pack|bpe)_")


def with_ctes(body: str) -> str:
    """Put the needed table expressions, in order, before the body."""
    order: list[str] = []

    def visit(text: str, me: str | None = None) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z]+\d?(?:_[a-z]+)?\b", text)):
            if name in CTES and name not in order and name != me:
                visit(CTES[name], name)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    word = "WITH RECURSIVE" if any(RECURSIVE.match(n) for n in order) else "WITH"
    heads = ",\n".join(f"{n} AS {'' if RECURSIVE.match(n) else 'MATERIALIZED '}({CTES[n]})" for n in order)
    tail = body.strip()
    if tail.upper().startswith("WITH"):
        tail = f"SELECT * FROM ({tail})"
    return f"{word} {heads}\n{tail}"
