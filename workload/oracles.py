"""The registered queries as SQL, built from a few shared pieces."""

from __future__ import annotations

import re
from collections.abc import Sequence

VIEWS = {
    "v1": """SELECT c_nationkey AS client, o_orderkey, c_mktsegment, o_orderpriority,
        o_orderstatus = 'F' AS label, o_totalprice > 250000 AS pred, o_totalprice, c_acctbal
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v2": """SELECT s_nationkey AS client, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        l_returnflag, l_linestatus, l_quantity > 25 AS label, l_discount >= 0.05::DOUBLE AS pred, l_quantity,
        l_discount, l_tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "v3": """SELECT source AS client, labels.doc_id, lang, quality = 1 AS label, toxic = 0 AS pred
        FROM labels JOIN documents ON labels.doc_id = documents.doc_id""",
    "v4": """SELECT user_id % 10 AS client, event_id, event_type, value > 10 AS label, value, ts FROM events""",
    "coded": """SELECT s_nationkey AS client, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        CASE WHEN l_linestatus = 'F' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS SEX,
        CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS RAC1P,
        (l_linenumber % 3 + 1)::DOUBLE AS MAR, l_quantity > 25 AS label, l_discount, l_tax
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
}
ITEM_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def with_(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then


def view(name: str) -> str:
    return f"{name} AS ({VIEWS[name]})"


def rates(source: str, attributes: Sequence[str], pred: str = "label", by: str = "client",
          empty: str = "zero", label: str = "label") -> str:
    """Per group: n, selection rate, true and false positive rate."""
    long = " UNION ALL ".join(
        f"SELECT {by}, '{a}' AS attribute, {a}::VARCHAR AS g, {label}::INT AS y, {pred}::INT AS p FROM {source} "
        f"WHERE {a} IS NOT NULL" for a in attributes)
    return rates_of(long, by, empty)


def rates_of(long: str, by: str = "client", empty: str = "zero") -> str:
    def rate(hit: str, rows: str) -> str:
        made = f"sum({hit}) / nullif(sum({rows}), 0)"
        return f"coalesce({made}, 0.0::DOUBLE)" if empty == "zero" else made

    return f"""long AS ({long}),
rates AS (SELECT {by}, attribute, g, count(*) AS n, {rate('p', '1')} AS selection_rate, {rate('y * p', 'y')} AS tpr,
  {rate('(1 - y) * p', '1 - y')} AS fpr FROM long GROUP BY {by}, attribute, g)"""


def pairs(metric: str, by: str = "client") -> str:
    """Every ordered pair of groups with its signed gap."""
    if metric == "DP":
        gap = "a.selection_rate - b.selection_rate"
    else:
        gap = ("CASE WHEN abs(a.tpr - b.tpr) >= abs(a.fpr - b.fpr) THEN a.tpr - b.tpr ELSE a.fpr - b.fpr END")
    keys = ", ".join(f"a.{c.strip()}" for c in by.split(","))
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    return f"""pairs AS (SELECT {keys}, a.attribute, '{metric}' AS metric, a.g || '_' || b.g AS pair, a.g AS g_i,
  b.g AS g_j, {gap} AS gap FROM rates a JOIN rates b ON {on} AND a.attribute = b.attribute)"""


def worst(by: str = "client") -> str:
    """The first pair, in row-major order of the groups, having the largest gap."""
    return f"""worst AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {by}, attribute
  ORDER BY gap DESC, g_i, g_j) AS rn FROM pairs WHERE gap IS NOT NULL) WHERE rn = 1)"""


FAIR = "client, attribute, metric, pair, g_i, g_j, gap"
V1_ATTRS = ("c_mktsegment", "o_orderpriority")
V2_ATTRS = ("l_returnflag", "l_linestatus")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def gaps(name: str, attributes: Sequence[str], metric: str, level: str, pred: str = "label",
         empty: str = "zero") -> str:
    parts = [view(name), rates(name, attributes, pred, empty=empty), pairs(metric)]
    if level == "attribute-value":
        return with_(*parts, then=f"SELECT {FAIR} FROM pairs")
    columns = FAIR if level == "value" else "client, attribute, metric, gap"
    return with_(*parts, worst(), then=f"SELECT {columns} FROM worst")


def ranked(source: str, by: str, key: str, out: str = "ranked", seed: int = 42) -> str:
    """Rank and group size in the seeded hash order."""
    keys = [k.strip() for k in key.split(",")]
    digest = f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"
    return (f"{out} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {digest}, {key}) AS rn, "
            f"count(*) OVER (PARTITION BY {by}) AS total FROM {source})")


def piece(k: str) -> str:
    """The piece of a rank among k near-equal ones."""
    q, m = f"(total // {k})", f"(total % {k})"
    return (f"CASE WHEN rn <= {m} * ({q} + 1) THEN (rn - 1) // ({q} + 1) "
            f"ELSE {m} + (rn - 1 - {m} * ({q} + 1)) // greatest({q}, 1) END")


def fold(fractions: Sequence[float]) -> str:
    first, second = fractions[0], fractions[0] + fractions[1]
    return (f"CASE WHEN rn <= floor(total * {first!r}::DOUBLE) THEN 'train' "
            f"WHEN rn <= floor(total * {second!r}::DOUBLE) THEN 'val' ELSE 'test' END")


def perturbed(source: str, pred: str, drop: str, flip: str, columns: str, key: str, out: str = "done") -> str:
    """Drop and then flip positives of a group, in hash order."""
    return f"""{out}_hits AS (SELECT {key}, rn, floor(total * {drop}) AS d,
  floor((total - floor(total * {drop})) * {flip}) AS f FROM (SELECT *, row_number() OVER (PARTITION BY client
  ORDER BY md5('42:' || {key}), {key}) AS rn, count(*) OVER (PARTITION BY client) AS total
  FROM {source} WHERE ({pred}) AND label)),
{out} AS (SELECT {columns}, CASE WHEN h.rn <= h.d + h.f THEN false ELSE label END AS label FROM {source} s
  LEFT JOIN {out}_hits h USING ({key}) WHERE h.rn IS NULL OR h.rn > h.d)"""


# --- the coded table's scores --------------------------------------------------------------------------------

SCORED = f"""scored AS (SELECT *, 'LogisticRegression' AS model, l_discount >= 0.05::DOUBLE AS pred FROM coded
  UNION ALL SELECT *, 'XGBoost' AS model, l_tax >= 0.04::DOUBLE AS pred FROM coded)"""
CODES = ("SEX", "RAC1P", "MAR")


def score_parts(metric: str) -> list[str]:
    by = "client, model"
    columns = ",\n  ".join(
        f"max(CASE WHEN attribute = '{a}' THEN gap END) AS {metric}_{n}, "
        f"max(CASE WHEN attribute = '{a}' THEN pair END) AS value_{metric}_{n}"
        for a, n in zip(CODES, ("SEX", "RACE", "MAR")))
    return [
        view("coded"), SCORED, rates("scored", CODES, "pred", by), pairs(metric, by), worst(by),
        "right_ AS (SELECT client, model, sum((label = pred)::INT) / count(*) AS accuracy FROM scored "
        "GROUP BY client, model)",
        f"wide AS (SELECT client, model, {columns} FROM worst GROUP BY client, model)",
        "scores AS (SELECT client AS dataset, model, accuracy, wide.* EXCLUDE (client, model) FROM wide "
        "JOIN right_ USING (client, model))",
    ]


VOTE = """vote AS (SELECT dataset, votes::BIGINT AS votes,
  CASE votes WHEN 2 THEN 'SEX' WHEN 0 THEN 'RAC1P' END AS vote,
  CASE votes WHEN 2 THEN s WHEN 0 THEN r END AS min_gap
  FROM (SELECT dataset, sum((DP_SEX > DP_RACE)::INT) AS votes, min(DP_SEX) AS s, min(DP_RACE) AS r
  FROM scores GROUP BY dataset))"""
VALUE_VOTE = """codes AS (SELECT *, split_part(value_DP_RACE, '_', 1)::DOUBLE::INT AS c1,
  split_part(value_DP_RACE, '_', 2)::DOUBLE::INT AS c2 FROM scores),
value_vote AS (SELECT dataset, CASE WHEN count(DISTINCT c2) = 1 THEN min(c2) END AS vote, min(DP_RACE) AS min_gap,
  max(CASE WHEN model = 'LogisticRegression' THEN c1 END) AS first_code,
  max(CASE WHEN model = 'LogisticRegression' THEN c2 END) AS last_code FROM codes GROUP BY dataset)"""
PLAN = """plan AS (SELECT dataset::VARCHAR AS client, 0::INT AS seq, coalesce(vote, 'SEX') AS "column",
  '2' AS value, {rate}::DOUBLE AS drop_rate, 0.0::DOUBLE AS flip_rate, NULL::VARCHAR AS column2,
  NULL::VARCHAR AS value2 FROM vote WHERE vote IS NULL OR min_gap < 0.09::DOUBLE)"""


def calibrated() -> str:
    """All nine rounds: each plans from the scores of the clients changed last, changes those anew, and scores their held-out rows.

    A plan of fewer than two clients is not applied and ends the rounds, so all later ones find no rows.
    """
    tables = "scored long rates pairs worst right_ wide scores vote_of".split()
    parts = [view("coded"), "rows0 AS (SELECT * FROM coded)"]
    for k in range(10):
        if k:
            parts += [
                f"""flagged{k} AS MATERIALIZED (SELECT dataset AS client, coalesce(vote, 'SEX') AS picked FROM vote_of{k - 1}
  WHERE vote IS NULL OR min_gap < 0.09::DOUBLE)""",
                f"plan{k} AS MATERIALIZED (SELECT * FROM flagged{k} WHERE (SELECT count(*) FROM flagged{k}) > 1)",
                f"mine{k} AS (SELECT c.*, label AND CASE picked WHEN 'SEX' THEN SEX = 2 ELSE RAC1P = 2 END AS hit FROM coded c JOIN plan{k} USING (client))",
                ranked(f"mine{k}", "client, hit", ITEM_KEY, f"drawn{k}"),
                f"rows{k} AS (SELECT * EXCLUDE (hit, rn, total) FROM drawn{k} WHERE NOT hit OR rn > floor(total * {k / 10!r}::DOUBLE))"]
        parts += [
            ranked(f"rows{k}", "client, SEX, RAC1P", ITEM_KEY, f"ranked{k}"),
            f"""strata{k} AS (SELECT client, SEX, RAC1P, count(*) AS n, floor(count(*) * 0.2::DOUBLE) AS low,
  count(*) * 0.2::DOUBLE - floor(count(*) * 0.2::DOUBLE) AS rest FROM rows{k} GROUP BY ALL)""",
            f"""quota{k} AS (SELECT *, ceil(sum(n) OVER (PARTITION BY client) * 0.2::DOUBLE) - sum(low) OVER (PARTITION BY client) AS missing,
  row_number() OVER (PARTITION BY client ORDER BY rest DESC, SEX, RAC1P) AS turn FROM strata{k})""",
            f"""held{k} AS MATERIALIZED (SELECT ranked{k}.* FROM ranked{k} JOIN quota{k} USING (client, SEX, RAC1P)
  WHERE rn <= low + (turn <= missing)::INT)"""]
        scored = [SCORED.replace("FROM coded", f"FROM held{k}"), *score_parts("DP")[2:],
                  VOTE.replace("vote AS (SELECT dataset", "vote_of AS MATERIALIZED (SELECT dataset", 1)]
        parts += [re.sub(rf"\b({'|'.join(tables)})\b", rf"\g<1>{k}", part) for part in scored]
    applied = " UNION ALL ".join(f"SELECT *, {k} AS k FROM plan{k}" for k in range(1, 10))
    return with_(
        *parts, f"last_ AS (SELECT client, arg_max(picked, k) AS picked, max(k) AS k FROM ({applied}) GROUP BY client)",
        """sizes AS (SELECT client, count(*) AS n, count(*) FILTER (label) AS positives, count(*) FILTER (label AND SEX = 2) AS sex,
  count(*) FILTER (label AND RAC1P = 2) AS race FROM coded GROUP BY client)""",
        """gone AS (SELECT client, n, positives, coalesce(floor(CASE picked WHEN 'SEX' THEN sex ELSE race END * (k / 10::DOUBLE)), 0)::BIGINT AS d
  FROM sizes LEFT JOIN last_ USING (client))""",
        then="SELECT client, n - d AS n, positives - d AS positives FROM gone")


def on_scores(*more: str, then: str) -> str:
    return with_(*score_parts("DP"), *more, then=then)


# --- logistic regressions ---------------------------------------------------------------------------------------

def newton(source: str, features: Sequence[str], l2: float = 1.0, steps: int = 14) -> list[str]:
    """Newton's method for one regression per client, a few tables a step; the last holds the weights b0, b1, ..."""
    d = len(features)
    n = range(d + 1)
    upper = [(i, j) for i in n for j in n if i <= j]
    parts = [f"r AS MATERIALIZED (SELECT client, label::INT::DOUBLE AS y, count(*) AS m, "
             + ", ".join(f"{x}::DOUBLE AS x{i}" for i, x in enumerate([*features, "1"])) + f" FROM {source} GROUP BY ALL)",
             "w0 AS (SELECT DISTINCT client, " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in n) + " FROM r)"]
    for k in range(steps):
        z = " + ".join(f"b{i} * x{i}" for i in n)
        sums = [f"sum(m * (p - y) * x{i}) + {l2 if i < d else 0.0!r}::DOUBLE * any_value(b{i}) AS g{i}" for i in n]
        sums += [f"sum(m * p * (1 - p) * x{i} * x{j}) + {l2 if i == j < d else 0.0!r}::DOUBLE AS h{i}_{j}" for i, j in upper]
        sums += [f"any_value(b{i}) AS b{i}" for i in n]
        parts.append(f"e{k}_0 AS MATERIALIZED (SELECT client, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p "
                     f"FROM r JOIN w{k} USING (client)) GROUP BY client)")
        for c in range(d):
            # Row c of the symmetric system is taken off all rows below it.
            off = [f"g{i} - h{c}_{i} / h{c}_{c} * g{c} AS g{i}" for i in n if i > c]
            off += [f"h{i}_{j} - h{c}_{i} / h{c}_{c} * h{c}_{j} AS h{i}_{j}" for i, j in upper if i > c]
            parts.append(f"e{k}_{c + 1} AS (SELECT * REPLACE ({', '.join(off)}) FROM e{k}_{c})")
        last = f"e{k}_{d}"
        for i in reversed(n):
            known = "".join(f" - h{i}_{j} * d{j}" for j in n if j > i)
            parts.append(f"u{k}_{i} AS (SELECT *, (g{i}{known}) / h{i}_{i} AS d{i} FROM {last})")
            last = f"u{k}_{i}"
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT client, " + ", ".join(f"b{i} - d{i} AS b{i}" for i in n) + f" FROM {last})")
    parts.append(f"weights AS (SELECT * FROM w{steps})")
    return parts


# --- distributions --------------------------------------------------------------------------------------------

THIRDS = f"parts AS (SELECT *, (o_orderkey % 3)::INT AS partition_id FROM v1)"
COUNTED = ("counted AS (" + " UNION ALL ".join(
    f"SELECT client, partition_id, '{a}' AS attribute, {a} AS value, count(*) AS n FROM parts "
    f"WHERE {a} IS NOT NULL GROUP BY ALL" for a in V1_ATTRS) + ")")


def level(name: str, client: str, part: str) -> str:
    group = ", ".join(["attribute", *[c for c in (client, part) if not c.startswith("NULL")]])
    return (f"SELECT '{name}' AS level, {client} AS client, {part} AS partition_id, attribute, value, "
            f"round_even(sum(n) / sum(sum(n)) OVER (PARTITION BY {group}), 3) AS share FROM counted "
            f"GROUP BY {group}, value")


SHARES = "shares AS (" + " UNION ALL ".join([
    level("overall", "NULL::INT", "NULL::INT"), level("client", "client", "NULL::INT"),
    level("partition", "client", "partition_id")]) + ")"

_MINMAX = ("SELECT client, l_orderkey, l_linenumber, l_partkey, "
           + ", ".join(f"({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0) AS {c}"
                       for c in ("l_quantity", "l_extendedprice")) + " FROM v2 WINDOW w AS ({})")


def intersection(pred: str) -> str:
    return rates_of(
        "SELECT client, 'l_returnflag*l_linestatus' AS attribute, "
        "'(''' || l_returnflag || ''', ''' || l_linestatus || ''')' AS g, label::INT AS y, "
        f"{pred}::INT AS p FROM v2 WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL")


COMPARED = [
    view("v1"), perturbed("v1", "c_mktsegment = 'BUILDING'", "0.5::DOUBLE", "0.0::DOUBLE",
                          "client, c_mktsegment", "o_orderkey"),
    "both_ AS (SELECT 1 AS t, client, c_mktsegment, label FROM v1 UNION ALL SELECT 2, client, c_mktsegment, label "
    "FROM done)",
    "r AS (SELECT t, client, c_mktsegment, sum(label::INT) / count(*) AS rate FROM both_ GROUP BY ALL)",
    "g AS (SELECT t, client, max(rate) - min(rate) AS gap FROM r GROUP BY t, client)",
    "compared AS (SELECT a.client, a.gap AS fairness1, b.gap AS fairness2 FROM g a JOIN g b ON a.client = b.client "
    "AND a.t = 1 AND b.t = 2)",
]

ORACLES: dict[str, str] = {
    "selection_rates": with_(view("v1"), rates("v1", V1_ATTRS, "pred"),
                             then="SELECT client, attribute, g, n, selection_rate FROM rates"),
    "true_false_rates": with_(view("v3"), rates("v3", ("lang",), "pred"),
                              then="SELECT client, attribute, g, n, tpr, fpr FROM rates"),
    "dp_pairs": gaps("v1", V1_ATTRS, "DP", "attribute-value"),
    "dp_attribute": gaps("v1", V1_ATTRS, "DP", "attribute"),
    "dp_value": gaps("v1", V1_ATTRS, "DP", "value"),
    "dp_wide_pairs": with_(
        view("v1"), rates("v1", ("c_mktsegment",)), pairs("DP"),
        then="SELECT client, " + ", ".join(
            f"max(CASE WHEN pair = '{a}_{b}' THEN gap END) AS \"{a}_{b}\"" for a in SEGMENTS for b in SEGMENTS)
        + " FROM pairs GROUP BY client"),
    "dp_wide_pairs_all": with_(
        view("coded"), rates("coded", CODES), pairs("DP"),
        then="SELECT client, " + ", ".join(
            f"max(CASE WHEN attribute = '{c}' AND pair = '{a}.0_{b}.0' THEN gap END) AS \"{c}_{a}.0_{b}.0\""
            for c, most in (("SEX", 2), ("RAC1P", 3), ("MAR", 3)) for a in range(1, most + 1) for b in range(1, most + 1))
        + " FROM pairs GROUP BY client"),
    "dp_wide_value": with_(
        view("v1"), rates("v1", V1_ATTRS), pairs("DP"), worst(),
        then="SELECT client, " + ", ".join(
            f"max(CASE WHEN attribute = '{a}' THEN gap END) AS {a}_DP, "
            f"max(CASE WHEN attribute = '{a}' THEN pair END) AS {a}_val" for a in V1_ATTRS)
        + " FROM worst GROUP BY client"),
    "eo_pairs": gaps("v3", ("lang",), "EO", "attribute-value", "pred"),
    "eo_value_docs": gaps("v3", ("lang",), "EO", "value", "pred"),
    "eo_value_orders": gaps("v1", V1_ATTRS, "EO", "value", "pred"),
    "eo_empty_as_null": gaps("v3", ("lang",), "EO", "value", "pred", "null"),
    "dataset_dp_sweep": gaps("v2", V2_ATTRS, "DP", "value"),
    "dataset_eo_sweep": gaps("v2", V2_ATTRS, "EO", "value"),
    "dp_intersection": with_(view("v2"), intersection("label"), pairs("DP"), worst(), then=f"SELECT {FAIR} FROM worst"),
    "eo_intersection": with_(view("v2"), intersection("pred"), pairs("EO"), worst(), then=f"SELECT {FAIR} FROM worst"),
    "coded_dp_value": gaps("coded", CODES, "DP", "value"),
    "partition_fairness": with_(
        view("v1"), "parts AS (SELECT *, (o_orderkey % 4)::INT AS partition_id FROM v1)",
        rates("parts", V1_ATTRS, by="client, partition_id"), pairs("DP", "client, partition_id"),
        worst("client, partition_id"), then=f"SELECT partition_id, {FAIR} FROM worst"),
    "first_partitions_fairness": with_(
        view("v1"), ranked("v1", "client", "o_orderkey"),
        f"parts AS (SELECT *, ({piece('4')})::INT AS partition_id FROM ranked)",
        rates("parts", V1_ATTRS, by="client, partition_id"), pairs("DP", "client, partition_id"),
        worst("client, partition_id"),
        then="SELECT client, partition_id, attribute, gap FROM worst WHERE partition_id < 3"),
    "value_counts": with_(view("v1"), THIRDS, COUNTED, then="SELECT * FROM counted"),
    "value_counts_events": with_(
        view("v4"), then="SELECT client, 'event_type' AS attribute, event_type AS value, count(*) AS n FROM v4 "
        "WHERE event_type IS NOT NULL GROUP BY ALL"),
    "value_percent": with_(
        view("v1"), THIRDS, COUNTED, then="SELECT client, partition_id, attribute, value, "
        "100 * n / sum(n) OVER (PARTITION BY client, partition_id, attribute) AS percent FROM counted"),
    "proportions": with_(view("v1"), THIRDS, COUNTED, SHARES, then="SELECT level, client::VARCHAR AS client, "
                         "partition_id::VARCHAR AS partition_id, attribute, value, share FROM shares"),
    "proportions_json": with_(
        view("v1"), THIRDS, COUNTED, SHARES,
        then="SELECT level, client::VARCHAR AS client, partition_id::VARCHAR AS partition_id, attribute, "
        "'{' || string_agg('\"' || value || '\":' || share, ',' "
        "ORDER BY value) || '}' AS shares FROM shares GROUP BY level, client, partition_id, attribute"),
    "profile": with_(view("v4"), then="SELECT count(*) AS n_rows, "
                     "'[\"client\",\"event_id\",\"event_type\",\"value\",\"ts\"]' AS columns FROM v4"),
    "frequencies": with_(view("v2"), then=" UNION ALL ".join(
        f"SELECT client, '{a}' AS attribute, {a} AS value, count(*) AS n FROM v2 GROUP BY ALL" for a in V2_ATTRS)),
    "chosen_clients": "SELECT c_nationkey, c_custkey, c_acctbal, c_mktsegment, c_acctbal > 5000 AS rich "
                      "FROM customer WHERE c_nationkey IN (0, 3, 7)",
    "remap": with_(view("coded"), then=f"SELECT client, {ITEM_KEY}, CASE RAC1P WHEN 1 THEN 2.0::DOUBLE "
                   "WHEN 2 THEN 3.0::DOUBLE WHEN 3 THEN 1.0::DOUBLE ELSE RAC1P END AS RAC1P, "
                   "CASE MAR WHEN 3 THEN 2.0::DOUBLE ELSE MAR END AS MAR FROM coded"),
    "remap_long": with_(view("v1"), then=f"SELECT client, o_orderkey, CASE o_orderkey WHEN 1 THEN {2**53 + 2} "
                        f"WHEN 3 THEN {2**53 + 5} ELSE o_orderkey + {2**53} END AS code FROM v1"),
    "remap_text": with_(view("v1"), then="SELECT client, o_orderkey, CASE o_orderpriority "
                        "WHEN '1-URGENT' THEN '2-HIGH' WHEN '2-HIGH' THEN '3-MEDIUM' "
                        "WHEN '5-LOW' THEN '4-NOT SPECIFIED' ELSE o_orderpriority END AS o_orderpriority FROM v1"),
    "binarize": with_(view("coded"), then=f"SELECT client, {ITEM_KEY}, (SEX = 1)::INT AS SEX, (MAR = 1)::INT AS MAR, "
                      "(RAC1P = 1)::INT AS RAC1P, label::INT AS \">50K\" FROM coded"),
    "group_predicate": with_(view("v1"), then="SELECT client, o_orderkey FROM v1 WHERE c_mktsegment = 'BUILDING' "
                             "AND o_orderpriority = '1-URGENT' AND label"),
    "feature_view": with_(view("v1"), then="SELECT client, o_orderkey, o_totalprice, c_acctbal FROM v1"),
    "minmax": with_(view("v2"), then=_MINMAX.format("")),
    "minmax_by_client": with_(view("v2"), then=_MINMAX.format("PARTITION BY client")),
    "one_hot": with_(view("v2"), then=f"SELECT client, {ITEM_KEY}, " + ", ".join(
        f"({c} = '{v}')::INT AS {c}_{v}" for c, vs in (("l_returnflag", "ANR"), ("l_linestatus", "FO")) for v in vs)
        + " FROM v2"),
    "one_hot_index": with_(view("v2"), then=f"SELECT client, {ITEM_KEY}, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS hot0, "
                           "dense_rank() OVER (ORDER BY l_linestatus) - 1 AS hot1, dense_rank() OVER (ORDER BY l_partkey) - 1 "
                           "AS hot2 FROM v2"),
    "minmax_fitted": with_(
        view("v1"), ranked("v1", "client", "o_orderkey"), f"f AS (SELECT *, {fold((0.7, 0.15))} AS fold FROM ranked)",
        "b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM f WHERE fold = 'train')",
        then="SELECT client, o_orderkey, (o_totalprice - lo) / nullif(hi - lo, 0) AS o_totalprice FROM f, b"),
    "assemble": with_(view("v2"), then=f"SELECT client, {ITEM_KEY}, 3::INT AS width, "
                      "l_quantity::FLOAT::DOUBLE AS first, 1.0::DOUBLE AS bias FROM v2"),
    "drop_positive": with_(
        view("v1"), perturbed("v1", "c_mktsegment = 'BUILDING'", "0.29::DOUBLE", "0.0::DOUBLE", "client, o_orderkey",
                              "o_orderkey"), then="SELECT * FROM done"),
    "flip_positive": with_(
        view("v1"), perturbed("v1", "c_mktsegment = 'MACHINERY' AND o_orderpriority = '5-LOW'", "0.0::DOUBLE",
                              "0.4::DOUBLE", "client, o_orderkey", "o_orderkey"), then="SELECT * FROM done"),
    "modification_plan": with_(
        view("v1"),
        perturbed("v1", "c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'", "0.2::DOUBLE", "0.1::DOUBLE",
                  "client, o_orderkey, o_orderpriority", "o_orderkey", "one"),
        perturbed("one", "o_orderpriority = '1-URGENT' AND client % 2 = 0", "0.3::DOUBLE", "0.2::DOUBLE",
                  "client, o_orderkey", "o_orderkey", "two"), then="SELECT * FROM two"),
    "latest_modification": with_(
        view("v1"),
        "log AS (SELECT client::VARCHAR AS state, o_orderpriority[1]::INT / 10 AS drop_rate, "
        "CASE WHEN count(*) % 2 = 0 THEN 'SEX' ELSE 'RAC1P' END AS attribute, (count(*) % 5 + 1)::INT AS value "
        "FROM v1 GROUP BY client, o_orderpriority)",
        then="SELECT state, drop_rate, attribute, value FROM (SELECT *, row_number() OVER (PARTITION BY state "
        "ORDER BY drop_rate DESC) AS rn FROM log) WHERE rn = 1"),
    "shuffle_order": with_(view("v4"), then="SELECT client, event_id, md5('42:' || event_id) AS position FROM v4"),
    "iid_partitions": with_(view("v1"), ranked("v1", "client", "o_orderkey"),
                            then=f"SELECT client, o_orderkey, ({piece('7')})::INT AS partition_id FROM ranked"),
    "iid_partitions_per_client": with_(
        view("v4"),
        "sized AS (SELECT *, CASE client WHEN 0 THEN 3 WHEN 1 THEN 30 WHEN 5 THEN 7 ELSE 1 END AS k FROM v4)",
        ranked("sized", "client", "event_id"),
        then=f"SELECT client, event_id, ({piece('k')})::INT AS partition_id FROM ranked"),
    "own_partitions": with_(view("v1"), then="SELECT client, o_orderkey, (CASE WHEN label THEN o_orderkey % 2 "
                            "ELSE 2 END)::INT AS partition_id FROM v1"),
    "folds": with_(view("v1"), ranked("v1", "client", "o_orderkey"),
                   then=f"SELECT client, o_orderkey, {fold((0.7, 0.15))} AS fold FROM ranked"),
    "folds_then_partitions": with_(
        view("v4"), ranked("v4", "client", "event_id", "first_"),
        f"folded AS (SELECT client, event_id, {fold((0.6, 0.2))} AS fold FROM first_)",
        ranked("folded", "client, fold", "event_id"),
        then=f"SELECT client, event_id, fold, ({piece('4')})::INT AS partition_id FROM ranked"),
    "partitions_in_row_order": with_(
        "given AS (SELECT user_id % 10 AS client, event_id, row_number() OVER () AS place FROM events)",
        "first_ AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY client) AS total FROM given "
        "WINDOW w AS (PARTITION BY client ORDER BY place))",
        f"folded AS (SELECT client, event_id, place, {fold((0.7, 0.15))} AS fold FROM first_)",
        "second_ AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY client, fold) AS total FROM folded "
        "WINDOW w AS (PARTITION BY client, fold ORDER BY place))",
        then=f"SELECT client, event_id, fold, ({piece('4')})::INT AS partition_id FROM second_"),
    "client_folds": with_(
        view("v1"), "clients AS (SELECT DISTINCT client FROM v1)", ranked("clients", "1", "client"),
        then=f"SELECT v1.client, o_orderkey, {fold((0.7, 0.15))} AS fold FROM v1 JOIN ranked USING (client)"),
    "holdout": with_(view("v1"), ranked("v1", "client", "o_orderkey"),
                     then="SELECT client, o_orderkey, rn <= ceil(total * 0.2::DOUBLE) AS is_test FROM ranked"),
    "stratified_holdout": with_(
        view("v2"), ranked("v2", "client, l_returnflag, l_linestatus", ITEM_KEY),
        "strata AS (SELECT client, l_returnflag, l_linestatus, count(*) AS n, floor(count(*) * 0.2::DOUBLE) AS low, "
        "count(*) * 0.2::DOUBLE - floor(count(*) * 0.2::DOUBLE) AS rest FROM v2 GROUP BY ALL)",
        "quota AS (SELECT *, ceil(sum(n) OVER (PARTITION BY client) * 0.2::DOUBLE) "
        "- sum(low) OVER (PARTITION BY client) AS missing, "
        "row_number() OVER (PARTITION BY client ORDER BY rest DESC, l_returnflag, l_linestatus) AS turn "
        "FROM strata)",
        then=f"SELECT client, {ITEM_KEY}, rn <= low + (turn <= missing)::INT AS is_test FROM ranked "
        "JOIN quota USING (client, l_returnflag, l_linestatus)"),
    "chunks": with_(view("v1"), then="SELECT client, o_orderkey, (ntile(6) OVER (PARTITION BY client ORDER BY "
                    "o_orderkey) - 1)::INT AS chunk FROM v1"),
    "chunks_with_nulls": with_(view("v1"), then="SELECT client, o_orderkey, (ntile(6) OVER (PARTITION BY client ORDER BY "
                               "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END NULLS FIRST, o_orderkey) - 1)::INT AS chunk "
                               "FROM v1"),
    "chunk_names": with_(
        view("v4"), "c AS (SELECT client, event_id, ntile(3) OVER (PARTITION BY client ORDER BY ts, event_id) - 1 AS "
        "chunk FROM v4)",
        then="SELECT client || '_' || chunk AS client_name, count(*) AS n, min(event_id) AS first_id, "
        "max(event_id) AS last_id FROM c GROUP BY client, chunk"),
    "one_partition": with_(
        view("v4"), ranked("v4", "client", "event_id"),
        f"parts AS (SELECT client, event_id, ({piece('5')})::INT AS partition_id FROM ranked)",
        then="SELECT * FROM parts WHERE client = 3 AND partition_id = 1"),
    "client_index": with_(
        view("v1"), "named AS (SELECT DISTINCT c_mktsegment || '_' || client AS client_name FROM v1)",
        then="SELECT row_number() OVER (ORDER BY client_name) - 1 AS client_index, client_name FROM named"),
    "prepared_dataset": with_(
        view("v1"),
        "mapped AS (SELECT client, o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN '4-NOT SPECIFIED' "
        "ELSE o_orderpriority END AS o_orderpriority, label FROM v1)",
        perturbed("mapped", "o_orderpriority = '4-NOT SPECIFIED' AND client IN (1, 2, 3)", "0.25::DOUBLE",
                  "0.5::DOUBLE", "client, o_orderkey, o_orderpriority", "o_orderkey"),
        ranked("done", "client", "o_orderkey", "first_"),
        f"folded AS (SELECT client, o_orderkey, o_orderpriority, label, {fold((0.7, 0.15))} AS fold FROM first_)",
        ranked("folded", "client, fold", "o_orderkey"),
        then="SELECT client, o_orderkey, o_orderpriority, label, fold, client || '_' || fold AS split, "
        f"({piece('3')})::INT AS partition_id FROM ranked"),
    "preprocessed_dataset": with_(
        view("v1"), "big AS (SELECT client, o_orderkey, o_totalprice / 2 AS o_totalprice FROM v1 WHERE o_totalprice > 50000)",
        ranked("big", "client", "o_orderkey"),
        then=f"SELECT client, o_orderkey, o_totalprice, {fold((0.7, 0.15))} AS fold FROM ranked"),
    "accuracy": with_(view("v1"), then="SELECT client, count(*) AS n, sum((label = pred)::INT) / count(*) AS accuracy "
                      "FROM v1 GROUP BY client"),
    "weighted_accuracy": with_(
        view("v1"), "a AS (SELECT client, count(*) AS n, sum((label = pred)::INT) / count(*) AS accuracy FROM v1 "
        "GROUP BY client)", then="SELECT round(sum(n * accuracy) / sum(n), 6) AS accuracy FROM a"),
    "weighted_vectors": "SELECT label, j::INT AS j, round(sum(n * x) / sum(n), 6) AS x FROM (SELECT label, vec_id % 5 + 1 AS n, "
                        "unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS j FROM embeddings) GROUP BY label, j",
    "own_metric": with_(
        view("v1"), rates("v1", V1_ATTRS, "pred"), pairs("DP"), worst(),
        "a AS (SELECT client, sum((label = pred)::INT) / count(*) AS accuracy, "
        "2 * sum(label::INT * pred::INT) / (sum(label::INT) + sum(pred::INT)) AS f1 FROM v1 GROUP BY client)",
        then="SELECT client, any_value(accuracy) AS accuracy, any_value(f1) AS f1, max(gap) FILTER (attribute = 'c_mktsegment') AS "
        "DP_c_mktsegment, max(gap) FILTER (attribute = 'o_orderpriority') AS DP_o_orderpriority FROM worst JOIN a USING (client) GROUP BY client"),
    "own_metric_gaps": with_(
        view("v1"), "long AS (" + " UNION ALL ".join(
            f"SELECT client, '{a}' AS attribute, {a} AS g, label::INT AS y, pred::INT AS p FROM v1" for a in V1_ATTRS) + ")",
        "f AS (SELECT client, attribute, g, 2 * sum(y * p) / nullif(sum(y) + sum(p), 0) AS f1 FROM long GROUP BY client, attribute, g)",
        then="SELECT client, attribute, max(f1) - min(f1) AS gap, first(g ORDER BY f1 DESC, g) AS g_i, first(g ORDER BY f1, g) AS g_j "
        "FROM f WHERE f1 IS NOT NULL GROUP BY client, attribute"),
    "log_loss": with_(
        view("v2"), "p AS (SELECT client, label, l_discount * 5 + 0.2::DOUBLE AS p FROM v2)",
        then="SELECT client, round(avg(-ln(CASE WHEN label THEN greatest(1e-15, least(1 - 1e-15, p)) "
        "ELSE 1 - greatest(1e-15, least(1 - 1e-15, p)) END)), 6) AS log_loss FROM p GROUP BY client"),
    "score_table_attribute": with_(*score_parts("DP"), then="SELECT dataset AS client, model, accuracy, DP_SEX, "
                                   "DP_RACE, DP_MAR FROM scores"),
    "score_table_value": with_(*score_parts("EO"), then="SELECT dataset AS client, * EXCLUDE (dataset) FROM scores"),
    "model_minimum": on_scores(then="SELECT dataset, min(DP_RACE) AS min_gap FROM scores GROUP BY dataset"),
    "attribute_vote": on_scores(VOTE, then="SELECT * FROM vote"),
    "value_vote": on_scores(VALUE_VOTE, then="SELECT * REPLACE (vote::VARCHAR AS vote) FROM value_vote"),
    "next_plan_attribute": on_scores(VOTE, PLAN.format(rate=0.3), then="SELECT * FROM plan"),
    "next_plan_value": on_scores(
        VALUE_VOTE, then="SELECT dataset::VARCHAR AS client, 0::INT AS seq, 'RAC1P' AS \"column\", "
        "(CASE WHEN vote IS NULL THEN last_code ELSE first_code END)::VARCHAR AS value, 0.3::DOUBLE AS drop_rate, "
        "0.0::DOUBLE AS flip_rate, NULL::VARCHAR AS column2, NULL::VARCHAR AS value2 FROM value_vote "
        "WHERE vote IS NULL OR min_gap < 0.09::DOUBLE"),
    "selected_attribute": on_scores(
        VOTE, then="SELECT dataset, vote, min_gap FROM vote WHERE (vote = 'SEX' AND min_gap > 0.01::DOUBLE) OR "
        "(vote = 'RAC1P' AND min_gap > 0.005::DOUBLE AND min_gap < 0.06::DOUBLE)"),
    "selected_value": on_scores(VALUE_VOTE, then="SELECT dataset, vote, min_gap FROM value_vote "
                                "WHERE vote IS NOT NULL AND min_gap > 0.01::DOUBLE"),
    "distribution_attribute": on_scores(
        VOTE, then="SELECT vote AS attribute, count(*) AS number, string_agg(dataset::VARCHAR, ',' ORDER BY dataset) "
        "AS states FROM vote WHERE vote IS NOT NULL AND min_gap > 0.01::DOUBLE GROUP BY vote"),
    "distribution_value": on_scores(
        VALUE_VOTE, then="SELECT vote AS value_int, count(*) AS number, string_agg(dataset::VARCHAR, ',' "
        "ORDER BY dataset) AS states FROM value_vote WHERE vote IS NOT NULL GROUP BY vote"),
    "distribution_long": on_scores(VOTE, then="SELECT vote AS attribute, dataset FROM vote WHERE vote IS NOT NULL "
                                   "AND min_gap > 0.01::DOUBLE"),
    "unscored_rows": with_(view("v1"), then="SELECT client, count(*) AS rows, count(*) FILTER (o_orderkey % 7 = 0) AS unscored "
                           "FROM v1 GROUP BY client"),
    "before_after": with_(*COMPARED, then="SELECT * FROM compared"),
    "before_after_range": with_(
        *COMPARED, then="SELECT least(min(fairness1), min(fairness2)) - 0.05::DOUBLE AS low, "
        "greatest(max(fairness1), max(fairness2)) + 0.05::DOUBLE AS high FROM compared"),
    "union_tagged": with_(
        view("v1"), view("v4"),
        "e AS (SELECT client, event_type AS value, count(*) AS n FROM v4 GROUP BY ALL)",
        then=" UNION ALL ".join(
            f"SELECT client::BIGINT AS client, '{a}' AS attribute, {a} AS value, count(*)::DOUBLE AS n, "
            f"NULL::DOUBLE AS percent, "
            f"'orders' AS state FROM v1 GROUP BY client, {a}" for a in V1_ATTRS)
        + " UNION ALL SELECT client, 'event_type', value, NULL, 100 * n / sum(n) OVER (PARTITION BY client), 'events' "
        "FROM e"),
    "saved_clients": with_(view("v1"), then="SELECT o_orderkey, label, client AS split, (o_orderkey % 2)::INT AS "
                           "partition_id FROM v1"),
    "saved_scores": on_scores(then="SELECT model, accuracy, value_DP_SEX, DP_SEX, value_DP_RACE, DP_RACE, "
                              "value_DP_MAR, DP_MAR, dataset::VARCHAR AS dataset FROM scores"),
    "saved_counts": with_(view("v1"), THIRDS, COUNTED, then="SELECT * FROM counted"),
    "saved_client_files": with_(view("v1"), then="SELECT lpad(client::VARCHAR, 2, '0') AS client, o_orderkey, label FROM v1"),
    "clients_of_year": with_(view("v1"), then="SELECT client::VARCHAR AS client, o_orderkey FROM v1 WHERE client IN (1, 7, 12) "
                             "AND o_orderkey % 3 = 1 AND o_orderkey % 2 = 0"),
    "published_distribution": on_scores(
        VOTE, "named AS (SELECT vote, chr(65 + (dataset // 5)::INT) || chr(65 + (dataset % 5)::INT) AS s FROM vote "
        "WHERE vote IS NOT NULL AND min_gap > 0.01::DOUBLE)",
        then="SELECT count(*)::INT AS number, vote AS attribute, string_agg(s, ',' ORDER BY s) AS states FROM named GROUP BY vote"),
    "client_models": with_(
        view("coded"), *newton("coded", ("l_discount", "l_tax", "SEX")),
        then="SELECT client, " + ", ".join(f"round(b{i}, 4) AS w{i}" for i in range(4)) + " FROM weights"),
    "client_predictions": with_(
        view("coded"), ranked("coded", "client", ITEM_KEY),
        "held AS (SELECT *, rn <= ceil(total * 0.2::DOUBLE) AS is_test FROM ranked)",
        "train AS (SELECT * FROM held WHERE NOT is_test)", *newton("train", ("l_extendedprice", "l_discount", "l_tax")),
        "scored AS (SELECT held.*, 'LogisticRegression' AS model, b0 * l_extendedprice + b1 * l_discount + b2 * l_tax + b3 > 0 "
        "AS pred FROM held JOIN weights USING (client) WHERE is_test)", *score_parts("DP")[2:],
        then="SELECT model, accuracy, DP_SEX, DP_RACE, DP_MAR, dataset::VARCHAR AS dataset FROM scores"),
    "partition_sweep": with_(
        view("coded"), ranked("coded", "client", ITEM_KEY), f"folded AS (SELECT * EXCLUDE (rn, total), {fold((0.7, 0.15))} AS fold FROM ranked)",
        ranked("folded", "client, fold", ITEM_KEY, "again"),
        f"parts AS (SELECT * EXCLUDE (client, rn, total), client AS c, ({piece('2')})::INT AS partition_id, client * 10 + ({piece('2')})::INT AS client "
        "FROM again)",
        "train AS (SELECT * FROM parts WHERE fold = 'train')", *newton("train", ("l_discount", "l_tax")),
        "scored AS (SELECT parts.*, b0 * l_discount + b1 * l_tax + b2 > 0 AS pred FROM parts JOIN weights USING (client) "
        "WHERE fold = 'val')", rates("scored", CODES, "pred", "c, partition_id"), pairs("DP", "c, partition_id"), worst("c, partition_id"),
        then="SELECT * EXCLUDE (c), c AS client FROM worst"),
    "calibrated_rows": calibrated(),
    "cross_device_rules": with_(
        view("coded"),
        f"pieces AS (SELECT * REPLACE (client || '_' || (ntile(2) OVER (PARTITION BY client ORDER BY {ITEM_KEY}) - 1) AS client) "
        "FROM coded)",
        ranked("pieces", "client", ITEM_KEY), "held AS (SELECT * FROM ranked WHERE rn <= ceil(total * 0.2::DOUBLE))",
        SCORED.replace("FROM coded", "FROM held"), *score_parts("DP")[2:], VALUE_VOTE,
        "chosen AS (SELECT dataset FROM value_vote WHERE vote IS NOT NULL AND min_gap > 0.01::DOUBLE)",
        then="SELECT model, accuracy, value_DP_SEX, DP_SEX, value_DP_RACE, DP_RACE, value_DP_MAR, DP_MAR, dataset FROM scores "
        "WHERE dataset IN (SELECT dataset FROM chosen)"),
    "own_model_scores": with_(
        view("v1"), ranked("v1", "client", "o_orderkey"),
        "h AS (SELECT client, label, rn <= ceil(total * 0.2::DOUBLE) AS is_test FROM ranked)",
        "m AS (SELECT client, avg(label::INT) > 0.5 AS p FROM h WHERE NOT is_test GROUP BY client)",
        then="SELECT client, 'Majority' AS model, count(*) AS n, sum((label = p)::INT) / count(*) AS accuracy "
        "FROM h JOIN m USING (client) WHERE is_test GROUP BY client"),
    "modification_log": on_scores(
        VOTE, PLAN.format(rate=0.3), then="SELECT client AS state, drop_rate, \"column\" AS attribute, value::INT AS "
        "value FROM plan"),
    "plan_as_json": on_scores(
        VOTE, PLAN.format(rate=0.5), then="SELECT '{\"client\":\"' || client || '\",\"seq\":0,\"column\":\"' || "
        "\"column\" || '\",\"value\":\"2\",\"drop_rate\":0.5,\"flip_rate\":0.0}' AS json FROM plan"),
}
