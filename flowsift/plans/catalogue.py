"""All queries over the network operators, each with DuckDB SQL where SQL can express it.

The tables hold no packet capture, so events stand for packets (user_id is the flow key, event_type the protocol, value the
length, click and view are forward, signup is FIN), documents for payloads, embeddings for feature matrices, labels for verdicts, and error
or purchase events for labelled flows of six hours. The extractors get events as captured packets (captured()): users and seven servers talk
in both directions, the event type is a TCP flag.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.functions.scratch import written
from flowsift.operators import engines, evaluation, extractors, fitting, flow_table, flows, labels, neighbours, payl, transformers
from flowsift.plans import lifecycle, preprocess, reporting, store
from flowsift.sources import label_csv, packet_labels, pcap

TIMEOUT, SUBFLOW, SIX_HOURS = 21_600_000_000, 3_600_000_000, 21_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def packets(spark: SparkSession, d: str, *more: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("pkt_idx"), F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("string"), "UTC")).alias("ts_us"), "user_id", "event_type", F.col("value").alias("length"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("dst"), *more)


def flow_packets(spark: SparkSession, d: str) -> DataFrame:
    return flows.sessionize(packets(spark, d), ["user_id"], TIMEOUT)


FLOW = ["user_id", "flow_seq"]
P = """WITH p AS (SELECT event_id AS pkt_idx, epoch_us(ts) AS ts_us, user_id, event_type, value AS length,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS dst FROM events), """
S = P + f"""n AS (SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w > {TIMEOUT} THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pkt_idx)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pkt_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS flow_seq FROM n), """
HEADS = "heads AS (SELECT user_id, flow_seq, min(pkt_idx) AS flow_first FROM s GROUP BY ALL), idx AS (SELECT *, row_number() OVER (ORDER BY flow_first) - 1 AS flow_idx FROM heads) "


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(S + HEADS + "SELECT s.pkt_idx, idx.flow_idx FROM s JOIN idx USING (user_id, flow_seq)")
def q_flow_sessionize(spark, d):
    rows = flow_packets(spark, d)
    heads = flows.flow_index(rows.select(*FLOW, "flow_first").distinct())
    return rows.join(heads.select(*FLOW, "flow_idx"), FLOW).select("pkt_idx", "flow_idx")


@query(P + f"""n AS (SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL OR (CASE WHEN event_type IN ('signup', 'click', 'purchase') THEN event_type = 'signup' ELSE ts_us - lag(ts_us) OVER w > {TIMEOUT} END) THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pkt_idx))
 SELECT pkt_idx, sum(new) OVER (PARTITION BY user_id ORDER BY pkt_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS flow_seq FROM n""")
def q_flow_fin_boundary(spark, d):
    tcp = F.col("event_type").isin("signup", "click", "purchase")
    return flows.sessionize(packets(spark, d), ["user_id"], TIMEOUT, F.col("event_type") == "signup", tcp, width=1 << 12).select("pkt_idx", "flow_seq")


@query(S[:-2] + " SELECT user_id, flow_seq, round(sum(length), 4) AS total_sum_pkt_length, round(avg(length), 4) AS total_mean_pkt_length, round(min(length), 4) AS total_min_pkt_length, round(max(length), 4) AS total_max_pkt_length, round(stddev_pop(length), 4) AS total_std_pkt_length, count(length) AS total_n_packets FROM s GROUP BY ALL")
def q_flow_length_stats(spark, d):
    return rounded(flows.length_stats(flow_packets(spark, d), FLOW))


@query(S[:-2] + """ , a AS (SELECT user_id, flow_seq, count(*) AS n, sum(length) AS t, (arg_max(ts_us, pkt_idx) - arg_min(ts_us, pkt_idx)) / 1e6 AS sec FROM s GROUP BY ALL)
 SELECT user_id, flow_seq, round(CASE WHEN sec = 0 THEN n ELSE n / sec END, 4) AS total_packets_per_s, round(CASE WHEN sec = 0 THEN t ELSE t / sec END, 4) AS total_bytes_per_s FROM a""")
def q_flow_rates(spark, d):
    return rounded(flows.rates(flow_packets(spark, d), FLOW))


@query(S[:-2] + """ , g AS (SELECT user_id, flow_seq, (ts_us - lag(ts_us) OVER (PARTITION BY user_id, flow_seq ORDER BY pkt_idx)) / 1e6 AS gap FROM s)
 SELECT user_id, flow_seq, round(coalesce(stddev_pop(gap), -1), 7) AS total_iat_std, round(coalesce(min(gap), -1), 7) AS total_iat_min, round(coalesce(max(gap), -1), 7) AS total_iat_max, round(coalesce(sum(gap), -1), 7) AS total_iat_sum FROM g GROUP BY ALL""")
def q_flow_iat(spark, d):
    return rounded(flows.inter_arrival(flow_packets(spark, d), FLOW), 7)


DIRECTED = "f AS (SELECT *, event_type IN ('click', 'view') AS forward FROM s) "


_STATS = ", ".join(
    f"round(coalesce(sum(length) FILTER ({own}), -1), 7) AS {d}_sum_pkt_length, round(coalesce(avg(length) FILTER ({own}), -1), 7) AS {d}_mean_pkt_length, round(coalesce(min(length) FILTER ({own}), -1), 7) AS {d}_min_pkt_length, "
    f"round(coalesce(max(length) FILTER ({own}), -1), 7) AS {d}_max_pkt_length, round(coalesce(stddev_pop(length) FILTER ({own}), -1), 7) AS {d}_std_pkt_length, count(*) FILTER ({own}) AS {d}_n_packets, "
    f"round(count(*) FILTER ({own}) / coalesce(nullif((arg_max(ts_us, pkt_idx) FILTER ({own}) - arg_min(ts_us, pkt_idx) FILTER ({own})) / 1e6, 0), 1), 7) AS {d}_packets_per_s, "
    f"round(coalesce(sum(length) FILTER ({own}) / coalesce(nullif((arg_max(ts_us, pkt_idx) FILTER ({own}) - arg_min(ts_us, pkt_idx) FILTER ({own})) / 1e6, 0), 1), -1), 7) AS {d}_bytes_per_s, "
    f"round(coalesce(avg(pkt_idx % 64) FILTER ({own}), -1), 7) AS {d}_avg_ttl, round(coalesce(stddev_pop(gap) FILTER ({own}), -1), 7) AS {d}_iat_std, round(coalesce(min(gap) FILTER ({own}), -1), 7) AS {d}_iat_min, "
    f"round(coalesce(max(gap) FILTER ({own}), -1), 7) AS {d}_iat_max, round(coalesce(sum(gap) FILTER ({own}), -1), 7) AS {d}_iat_sum"
    for d, own in (("fwd", "forward"), ("bwd", "NOT forward"))
)


@query(S + DIRECTED + f", g AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY user_id, flow_seq, forward ORDER BY pkt_idx)) / 1e6 AS gap FROM f) SELECT user_id, flow_seq, {_STATS} FROM g GROUP BY ALL")
def q_flow_direction_stats(spark, d):
    rows = flow_packets(spark, d).withColumns({"forward": F.col("event_type").isin("click", "view"), "ttl": F.col("pkt_idx") % 64})
    rows = rows.withColumn("gap", (F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy(*FLOW, "forward").orderBy("pkt_idx"))) / 1e6)
    parts = (("fwd", F.col("forward")), ("bwd", ~F.col("forward")))
    return rounded(rows.groupBy(*FLOW).agg(*[c for name, own in parts for c in extractors.direction_features(name, own, "gap", "length")]), 7)


@query(S[:-2] + " SELECT pkt_idx, event_type = first_value(event_type) OVER (PARTITION BY user_id, flow_seq ORDER BY pkt_idx) AS forward FROM s")
def q_flow_orientation(spark, d):
    return flows.with_direction(flow_packets(spark, d), FLOW, ["event_type"]).select("pkt_idx", "forward")


SUB = f"""u AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_id, flow_seq ORDER BY pkt_idx) > {SUBFLOW} THEN 1 ELSE 0 END AS nw FROM s),
 v AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, flow_seq ORDER BY pkt_idx ROWS UNBOUNDED PRECEDING) AS sub FROM u),
 sp AS (SELECT user_id, flow_seq, sub, arg_min(ts_us, pkt_idx) AS a, arg_max(ts_us, pkt_idx) AS z FROM v GROUP BY ALL),
 ai AS (SELECT *, (z - a) / 1e6 AS active, (a - lag(z) OVER (PARTITION BY user_id, flow_seq ORDER BY sub)) / 1e6 AS idle FROM sp) """
_AI = ", ".join(f"count({n}) AS n_{n}_times, " + ", ".join(f"round(coalesce({f}({n}), 0), 8) AS {k}_{n}_time" for k, f in (("min", "min"), ("max", "max"), ("total", "sum"), ("std", "stddev_pop"), ("mean", "avg"))) for n in ("active", "idle"))


@query(S + SUB + f"SELECT user_id, flow_seq, count(*) AS n_subflows, {_AI} FROM ai GROUP BY ALL")
def q_subflows_active_idle(spark, d):
    return rounded(flows.active_idle(flow_packets(spark, d), FLOW, SUBFLOW), 8)


@query(S + DIRECTED + f""", u AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_id, flow_seq, forward ORDER BY pkt_idx) > {SUBFLOW} THEN 1 ELSE 0 END AS nw FROM f),
 v AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, flow_seq, forward ORDER BY pkt_idx ROWS UNBOUNDED PRECEDING) AS sub FROM u), a AS (SELECT user_id, flow_seq, forward, sub, count(*) AS n, sum(length) AS t FROM v GROUP BY ALL)
 SELECT user_id, flow_seq, round(coalesce(avg(n) FILTER (forward), 0), 4) AS fwd_subflow_avg_pkts, round(coalesce(avg(t) FILTER (forward), 0), 4) AS fwd_subflow_avg_length, round(coalesce(avg(n) FILTER (NOT forward), 0), 4) AS bwd_subflow_avg_pkts, round(coalesce(avg(t) FILTER (NOT forward), 0), 4) AS bwd_subflow_avg_length FROM a GROUP BY ALL""")
def q_subflow_direction_avgs(spark, d):
    rows = flow_packets(spark, d).withColumn("forward", F.col("event_type").isin("click", "view"))
    return rounded(flows.subflow_averages(rows, FLOW, SUBFLOW))


_HIND = {n: ", ".join({"src_ip": "user_id", "dest_ip": "dst", "src_port": "pkt_idx % 5", "dest_port": "pkt_idx % 3", "protocol": "event_type"}[c] for c in cols) for n, cols in extractors.HINDSIGHT.items()}


@query(S + HEADS + ", x AS (SELECT i.flow_idx, p.* FROM idx i JOIN p ON p.pkt_idx = i.flow_first) SELECT flow_idx, " + ", ".join(f"count(*) OVER (PARTITION BY {cols} ORDER BY flow_idx RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING) AS hindsight_{n}" for n, cols in _HIND.items()) + " FROM x")
def q_hindsight_counts(spark, d):
    heads = flow_packets(spark, d).where("pkt_idx = flow_first")
    heads = heads.select("flow_first", F.col("user_id").alias("src_ip"), F.col("dst").alias("dest_ip"), (F.col("pkt_idx") % 5).alias("src_port"), (F.col("pkt_idx") % 3).alias("dest_port"), F.col("event_type").alias("protocol"))
    return flows.hindsight_counts(flows.flow_index(heads), extractors.HINDSIGHT, 100).select("flow_idx", *[f"hindsight_{n}" for n in extractors.HINDSIGHT])


@query(S[:-2] + " SELECT user_id, flow_seq, round(avg(length), 4) AS tcp_fwd_win_mean, count(*) FILTER (event_type = 'error') AS tcp_fwd_total_urg, count(*) FILTER (event_type = 'signup') AS tcp_fwd_total_syn, count(*) FILTER (event_type = 'click') AS tcp_fwd_total_syn_ack, count(*) FILTER (event_type = 'purchase') AS tcp_fwd_total_ack, count(*) FILTER (event_type = 'view') AS tcp_fwd_total_fin, 0::BIGINT AS tcp_fwd_total_push, 0::BIGINT AS tcp_fwd_total_rst FROM s GROUP BY ALL")
def q_event_flag_counters(spark, d):
    flags = F.expr(f"CASE event_type WHEN 'error' THEN {C.URG} WHEN 'signup' THEN {C.SYN} WHEN 'click' THEN {C.SYN | C.ACK} WHEN 'purchase' THEN {C.ACK} ELSE {C.FIN} END")
    return rounded(flows.tcp_counters(flow_packets(spark, d).withColumn("tcp_flags", flags).withColumn("tcp_win", F.col("length")), FLOW))


@query(S[:-2] + """ , a AS (SELECT *, min(CASE WHEN event_type = 'view' THEN pkt_idx END) OVER (PARTITION BY user_id, flow_seq) AS ia FROM s),
 b AS (SELECT *, min(CASE WHEN event_type = 'click' AND pkt_idx > ia THEN pkt_idx END) OVER (PARTITION BY user_id, flow_seq) AS ib FROM a),
 c AS (SELECT *, min(CASE WHEN event_type = 'purchase' AND pkt_idx > ib THEN pkt_idx END) OVER (PARTITION BY user_id, flow_seq) AS ic FROM b),
 t AS (SELECT user_id, flow_seq, max(CASE WHEN pkt_idx = ia THEN ts_us END) AS ta, max(CASE WHEN pkt_idx = ib THEN ts_us END) AS tb, max(CASE WHEN pkt_idx = ic THEN ts_us END) AS tc FROM c GROUP BY ALL)
 SELECT user_id, flow_seq, round(coalesce(CASE WHEN tc IS NOT NULL THEN (tb - ta) / 1e6 END, -1), 6) AS tcp_syn_synack, round(coalesce(CASE WHEN tc IS NOT NULL THEN (tc - tb) / 1e6 END, -1), 6) AS tcp_synack_ack, round(coalesce(CASE WHEN tc IS NOT NULL THEN (tc - ta) / 1e6 END, -1), 6) AS tcp_rtt FROM t""")
def q_handshake_timings(spark, d):
    e = F.col("event_type")
    return rounded(flows.handshake(flow_packets(spark, d), FLOW, e == "view", e == "click", e == "purchase"), 6)


@query(P[:-2] + " SELECT pkt_idx, least(user_id, dst) AS ip_a, greatest(user_id, dst) AS ip_b, CASE WHEN user_id < dst THEN 1 ELSE 2 END AS port_a, CASE WHEN user_id < dst THEN 2 ELSE 1 END AS port_b, event_type AS protocol FROM p")
def q_flow_key_normalised(spark, d):
    key = C.flow_key(F.col("user_id"), F.col("dst"), F.lit(1), F.lit(2), F.col("event_type"))
    return packets(spark, d).select("pkt_idx", key.alias("k")).select("pkt_idx", "k.*")


@query(P[:-2] + " SELECT pkt_idx, concat_ws('-', user_id, dst, 1, 2, event_type) AS flow_id, concat_ws('-', dst, user_id, 2, 1, event_type) AS reverse_id FROM p")
def q_flow_id_text(spark, d):
    a = C.flow_id(F.col("user_id"), F.col("dst"), F.lit(1), F.lit(2), F.col("event_type"))
    return packets(spark, d).select("pkt_idx", a.alias("flow_id"), C.reverse_flow_id(a).alias("reverse_id"))


@query("SELECT event_id, " + ", ".join(f"CAST(event_id // {10**n} % 10 AS INTEGER) AS port_digit_{n}" for n in range(8)) + " FROM events")
def q_port_digits(spark, d):
    return table(spark, d, "events").select("event_id", *C.port_digits(F.col("event_id"), "port"))


@query("SELECT event_id, " + ", ".join(f"CASE WHEN ip < 65536 THEN -1 ELSE {f'CAST((ip >> {8 * (k - 1)}) & 255 AS INTEGER)' if k <= 4 else '-1'} END AS src_ip_dotted_{k}" for k in range(16, 0, -1)) + " FROM (SELECT event_id, event_id * 4099 AS ip FROM events)")
def q_ip_octets(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("event_id") * 4099).alias("ip")).select("event_id", *C.ip_octets(F.col("ip"), "src_ip"))


@query("SELECT event_id, CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT) AS rounded, CAST(ceil(epoch_us(ts) / 1e6) AS BIGINT) AS ceiled FROM events")
def q_time_round_ceil(spark, d):
    s = F.col("ts_us") / 1e6
    return packets(spark, d).select(F.col("pkt_idx").alias("event_id"), C.whole_seconds(s, "round").cast("long").alias("rounded"), C.whole_seconds(s, "ceil").cast("long").alias("ceiled"))


#: Names that labelled flows use and that stand for no number.
NO_PROTOCOL = ("ip", "any", "isis", "sccopmce")
PROTOCOL_NAMES = [*C.PROTOCOLS, *NO_PROTOCOL]


@query(f"""
WITH names(place, name, protocol) AS (VALUES {", ".join(f"({k}, '{n}', {C.PROTOCOLS.get(n, 'NULL')})" for k, n in enumerate(PROTOCOL_NAMES))})
SELECT event_id, name, protocol, CASE WHEN event_id % 256 BETWEEN 144 AND 252 THEN 144 ELSE event_id % 256 END AS assigned
FROM events JOIN names ON place = event_id % {len(PROTOCOL_NAMES)}""")
def q_protocol_map(spark, d):
    name = F.element_at(F.array(*map(F.lit, PROTOCOL_NAMES)), (F.col("event_id") % len(PROTOCOL_NAMES) + 1).cast("int"))
    written = F.concat(F.lit(" "), F.upper(name), F.lit(" "))
    return table(spark, d, "events").select("event_id", name.alias("name"), C.protocol_number(written).alias("protocol"), C.unassigned_protocol(F.col("event_id") % 256).alias("assigned"))


@query(S + "v AS (SELECT user_id, flow_seq, 1 AS label FROM s GROUP BY ALL HAVING count(*) >= 3) SELECT s.pkt_idx, coalesce(v.label, 0) AS label FROM s LEFT JOIN v USING (user_id, flow_seq)")
def q_map_backwards(spark, d):
    rows = flow_packets(spark, d)
    verdicts = rows.groupBy(*FLOW).count().where("count >= 3").select(*FLOW, F.lit(1).alias("label"))
    return flows.map_back(rows, verdicts, FLOW).select("pkt_idx", "label")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = packets(spark, d).where("event_type IN ('error', 'purchase')")
    kind = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return rows.select("user_id", F.col("ts_us").alias("start_us"), (F.col("ts_us") + SIX_HOURS).alias("end_us"), kind.alias("traffic_type"), F.col("event_type").alias("info"), F.col("pkt_idx").alias("seq"), F.when(F.col("pkt_idx") % 7 == 0, F.col("dst")).alias("dst"))


def clicks(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).where("event_type = 'click'").select("pkt_idx", "ts_us", "user_id", "dst")


LABELLED = P + f"""fl AS (SELECT user_id, ts_us AS start_us, ts_us + {SIX_HOURS} AS end_us, CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS tt, event_type AS info, pkt_idx AS seq, CASE WHEN pkt_idx % 7 = 0 THEN dst END AS src FROM p WHERE event_type IN ('error', 'purchase')),
 c AS (SELECT pkt_idx, ts_us, user_id, dst FROM p WHERE event_type = 'click') """


def _asof_sql(extra: str) -> str:
    return LABELLED + f""", r AS (SELECT c.pkt_idx, fl.*, row_number() OVER (PARTITION BY c.pkt_idx ORDER BY fl.start_us DESC, fl.tt ASC, fl.seq DESC) AS k FROM c JOIN fl ON fl.user_id = c.user_id AND fl.start_us <= c.ts_us {extra})
 SELECT c.pkt_idx, coalesce(r.tt, 0) AS traffic_type, CASE WHEN r.tt = 1 THEN r.info END AS attack_type, r.tt IS NOT NULL AS matched FROM c LEFT JOIN r ON r.pkt_idx = c.pkt_idx AND r.k = 1"""


ASOF = ["pkt_idx", "traffic_type", "attack_type", "matched"]


@query(_asof_sql(""))
def q_label_asof_start(spark, d):
    return labels.asof_labels(clicks(spark, d), labelled(spark, d), "user_id").select(*ASOF)


@query(_asof_sql("AND fl.end_us >= c.ts_us"))
def q_label_asof_interval(spark, d):
    return labels.asof_labels(clicks(spark, d), labelled(spark, d), "user_id", use_end=True).select(*ASOF)


@query(_asof_sql("AND (fl.src IS NULL OR fl.src = c.dst)"))
def q_label_unidirectional(spark, d):
    return labels.asof_labels(clicks(spark, d), labelled(spark, d), "user_id", source="dst").select(*ASOF)


@query(LABELLED + "SELECT a.user_id, a.seq AS first_seq, b.seq AS second_seq FROM fl a JOIN fl b ON a.user_id = b.user_id AND (b.start_us > a.start_us OR b.start_us = a.start_us AND b.seq > a.seq) AND (b.start_us < a.end_us OR b.start_us = a.start_us)")
def q_duplicate_flows(spark, d):
    return labels.duplicate_flows(labelled(spark, d), "user_id")


@query(LABELLED + "SELECT seq FROM fl WHERE start_us + seq % 3 * 1000000 - 1000000 < start_us")
def q_invalid_flows(spark, d):
    shifted = labelled(spark, d).withColumn("end_us", F.col("start_us") + F.col("seq") % 3 * 1_000_000 - 1_000_000)
    return labels.invalid_flows(shifted).select("seq")


@query(LABELLED + "SELECT pkt_idx FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.event_type = 'error' AND p.user_id = c.user_id AND p.dst = c.dst)")
def q_no_flow_diagnostics(spark, d):
    pair = F.concat_ws("-", "user_id", "dst").alias("pair")
    attacks = packets(spark, d).where("event_type = 'error'").select(pair)
    return labels.without_flow(clicks(spark, d).select("pkt_idx", pair), attacks, "pair").select("pkt_idx")


_ASSOCIATE = [(end, one) for end in (False, True) for one in (False, True)]


def _association_sql() -> str:
    """Flows are errors and purchases of a pair of user and target, every third in the other direction; of these every fifth has no answer."""
    base = P + f"""l AS (SELECT pkt_idx, CASE WHEN pkt_idx % 3 = 0 THEN dst ELSE user_id END AS a, CASE WHEN pkt_idx % 3 = 0 THEN user_id ELSE dst END AS b, ts_us AS start_us, ts_us + {20 * SIX_HOURS} AS end_us, event_type AS info,
      CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS tt, pkt_idx % 5 = 0 AS one FROM p WHERE event_type IN ('error', 'purchase')),
     fl AS (SELECT *, concat_ws('-', a, b, 1, 1, 6) AS id, concat_ws('-', b, a, 1, 1, 6) AS rid FROM l),
     ids AS (SELECT id FROM fl WHERE tt = 1), near AS (SELECT * FROM fl WHERE tt = 1 OR id IN (SELECT id FROM ids UNION ALL SELECT rid FROM fl WHERE tt = 1)),
     c AS (SELECT pkt_idx, ts_us, user_id, concat_ws('-', user_id, dst, 1, 1, 6) AS id, concat_ws('-', dst, user_id, 1, 1, 6) AS rid FROM p WHERE event_type = 'click') """
    parts = []
    for end, one in _ASSOCIATE:
        extra = (" AND near.end_us >= c.ts_us" if end else "") + (" AND (NOT near.one OR near.a = c.user_id)" if one else "")
        parts.append(f"""SELECT c.pkt_idx, '{end}-{one}' AS setting, coalesce(r.tt, 0) AS traffic_type, CASE WHEN r.tt = 1 THEN r.info END AS attack_type,
         CASE WHEN r.tt IS NULL AND (c.id IN (SELECT id FROM ids) OR c.rid IN (SELECT id FROM ids)) THEN 'no_flow' END AS diagnosis FROM c LEFT JOIN (SELECT c.pkt_idx, near.tt, near.info, row_number() OVER (PARTITION BY c.pkt_idx ORDER BY near.start_us DESC, near.tt) AS k
          FROM c JOIN near ON (near.id = c.id OR near.id = c.rid) AND near.start_us <= c.ts_us{extra} WHERE c.id IN (SELECT id FROM ids) OR c.rid IN (SELECT id FROM ids)) r ON r.pkt_idx = c.pkt_idx AND r.k = 1""")
    return base + " UNION ALL ".join(parts)


@query(_association_sql())
def q_label_association(spark, d):
    rows = packets(spark, d)
    ids = lambda a, b: (C.flow_id(a, b, F.lit(1), F.lit(1), F.lit(6)).alias("flow_id"), C.flow_id(b, a, F.lit(1), F.lit(1), F.lit(6)).alias("reverse_id"))
    turned = F.col("pkt_idx") % 3 == 0
    a, b = F.when(turned, F.col("dst")).otherwise(F.col("user_id")), F.when(turned, F.col("user_id")).otherwise(F.col("dst"))
    known = rows.where("event_type IN ('error', 'purchase')").select(*ids(a, b), F.col("ts_us").alias("start_us"), (F.col("ts_us") + 20 * SIX_HOURS).alias("end_us"), F.col("event_type").alias("info"), (F.col("event_type") == "error").cast("int").alias("traffic_type"), a.cast("string").alias("src_ip"), F.lit(1).alias("src_port"), F.lit(4).alias("src_packets"), F.when(F.col("pkt_idx") % 5 == 0, 0).otherwise(3).alias("dest_packets"))
    seen = rows.where("event_type = 'click'").select(F.col("pkt_idx").alias("packet_id"), "ts_us", *ids(F.col("user_id"), F.col("dst")), F.col("user_id").cast("string").alias("src_ip"), F.lit(1).alias("src_port"))
    found = [labels.associate(seen, known, end, one).select(F.col("packet_id").alias("pkt_idx"), F.lit(f"{end}-{one}").alias("setting"), "traffic_type", "attack_type", "diagnosis") for end, one in _ASSOCIATE]
    return reduce(DataFrame.unionByName, found)


@query(P[:-2] + " SELECT dst, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS signup, count(*) AS total, count(*) FILTER (event_type IN ('error', 'signup')) AS num_attacks, round(count(*) FILTER (event_type IN ('error', 'signup')) / count(*), 4) AS fraction_attacks FROM p GROUP BY dst")
def q_attack_stats_pivot(spark, d):
    rows = packets(spark, d).withColumn("attack_type", F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")))
    return rounded(labels.attack_stats(rows, "dst", ["error", "signup"]))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL")
def q_flows_per_protocol(spark, d):
    return label_csv.attacks_per_protocol(table(spark, d, "events").withColumn("traffic_type", (F.col("value") > 50).cast("int")), "event_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('ip', 'st') GROUP BY ALL")
def q_unknown_protocols(spark, d):
    return labels.unknown_protocols(labels.without_protocols(table(spark, d, "events"), ["IP ", "st"], "event_type"), "event_type")


@query("""WITH e AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL), a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL)
 SELECT coalesce(e.user_id, a.user_id) AS user_id, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual, coalesce(a.n, 0) - coalesce(e.n, 0) AS difference, round(CASE WHEN coalesce(e.n, 0) = 0 THEN 0.0 ELSE abs(coalesce(e.n, 0) - coalesce(a.n, 0)) / e.n END, 4) AS error FROM e FULL JOIN a ON e.user_id = a.user_id""")
def q_expected_vs_actual(spark, d):
    n = lambda t: table(spark, d, "events").where(F.col("event_type") == t).groupBy("user_id").agg(F.count("*").alias("n"))
    return rounded(labels.expected_actual(n("error"), n("purchase"), "user_id"))


VERDICTS = "WITH v AS (SELECT d.doc_id, d.lang AS part, d.source AS seq, l.quality AS truth, l.toxic AS predicted FROM documents d JOIN labels l USING (doc_id)) "


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("part"), F.col("source").alias("seq"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("predicted")), "doc_id")


@query(VERDICTS + "SELECT 'all' AS part_name, doc_id FROM v UNION ALL SELECT part, doc_id FROM v WHERE truth = 0 UNION ALL SELECT n.part, v.doc_id FROM v, (SELECT DISTINCT part FROM v WHERE truth = 0) n WHERE v.truth = 1")
def q_parts_membership(spark, d):
    return labels.parts(verdicts(spark, d), "doc_id", "part", F.col("truth") == 1)


_COUNTS = "count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 0 AND predicted = 0) AS tn, count(*) FILTER (truth = 1 AND predicted = 0) AS fn"


@query(VERDICTS + f"SELECT part, seq, {_COUNTS} FROM v GROUP BY ALL")
def q_confusion(spark, d):
    return evaluation.confusion(verdicts(spark, d), ["part", "seq"])


_sd = "CASE WHEN ({1}) = 0 THEN 'inf'::DOUBLE ELSE ({0}) / ({1}) END".format


def _metric_sql(by: str) -> str:
    k = f"1 - ({_sd('1 - ' + '(' + _sd('tp + tn', 'tp + fp + tn + fn') + ')', '1 - (' + _sd('(tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)', '(tp + fp + tn + fn) * (tp + fp + tn + fn)') + ')')})"
    out = {"recall": _sd("tp", "tp + fn"), "tnr": _sd("tn", "tn + fp"), "precision": _sd("tp", "tp + fp"), "npv": _sd("tn", "tn + fn"), "fpr": _sd("fp", "tn + fp"), "fdr": _sd("fp", "fp + tp"), "fnr": _sd("fn", "fn + tp"), "accuracy": _sd("tp + tn", "tp + fp + tn + fn"), "f1_score": _sd("2 * tp", "2 * tp + fp + fn"), "kappa": k, "mcc": _sd("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))")}
    return VERDICTS + f", c AS (SELECT {by}{', ' * bool(by)}{_COUNTS} FROM v GROUP BY ALL), m AS (SELECT {by}{', ' * bool(by)}tp::DOUBLE AS tp, fp::DOUBLE AS fp, tn::DOUBLE AS tn, fn::DOUBLE AS fn FROM c) SELECT {by}{', ' * bool(by)}{', '.join(f'round({v}, 4) AS {n}' for n, v in out.items())} FROM m"


METRICS = ["recall", "tnr", "precision", "npv", "fpr", "fdr", "fnr", "accuracy", "f1_score", "kappa", "mcc"]


@query(_metric_sql("part, seq"))
def q_metrics(spark, d):
    return rounded(evaluation.with_metrics(evaluation.confusion(verdicts(spark, d), ["part", "seq"])).select("part", "seq", *METRICS))


@query(_metric_sql("part"))
def q_metrics_total(spark, d):
    counts = evaluation.total_confusion(evaluation.confusion(verdicts(spark, d), ["part", "seq"]), ["part"])
    return rounded(evaluation.with_metrics(counts).select("part", *METRICS))


BYTES = """WITH d AS (SELECT doc_id, lang AS protocol, source AS port, (n_chars // 500) * 500 AS length, hex(encode(coalesce(text, ''))) AS h FROM documents),
 b AS (SELECT doc_id, ('0x' || x)::INTEGER AS byte, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS x FROM d) GROUP BY ALL),
 f AS (SELECT d.doc_id, d.protocol, d.port, d.length, CAST(i AS INTEGER) AS byte, coalesce(b.k, 0) / greatest(length(h) // 2, 1) AS freq FROM d CROSS JOIN range(256) t(i) LEFT JOIN b ON b.doc_id = d.doc_id AND b.byte = i),
 c AS (SELECT protocol, port, length, byte, avg(freq) AS mean, stddev_pop(freq) AS std, count(*) AS n FROM f GROUP BY ALL) """
NEAREST = """, r AS (SELECT d.doc_id, d.protocol, d.port, t.length AS near_length, row_number() OVER (PARTITION BY d.doc_id ORDER BY abs(t.length - d.length), t.length) AS k FROM d LEFT JOIN (SELECT DISTINCT protocol, port, length FROM c WHERE n >= 3) t ON t.protocol = d.protocol AND t.port = d.port),
 g AS (SELECT f.doc_id, f.protocol, coalesce(sum(abs(c.mean - f.freq) / (c.std + 0.0001)), -1) AS distance FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = 1 LEFT JOIN c ON c.protocol = f.protocol AND c.port = f.port AND c.length = r.near_length AND c.byte = f.byte GROUP BY ALL) """


@query(BYTES + "SELECT doc_id, byte, freq FROM f WHERE freq > 0")
def q_byte_frequencies(spark, d):
    rows = payl.byte_shares(table(spark, d, "documents"), "text", ["doc_id"])
    return rows.select("doc_id", F.posexplode("freq").alias("byte", "freq")).where("freq > 0")


def payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("protocol"), F.col("source").alias("port"), (F.floor(F.col("n_chars") / 500) * 500).alias("length"))


@query(BYTES + "SELECT protocol, port, length, n, byte, round(mean, 6) AS mean, round(std, 6) AS std FROM c")
def q_payl_centroids(spark, d):
    rows = payl.payload_centroids(payloads(spark, d), "text").select(*payl.KEY, "n", F.posexplode(F.arrays_zip("mean", "std")).alias("byte", "c"))
    return rows.select(*payl.KEY, "n", "byte", F.round("c.mean", 6).alias("mean"), F.round("c.std", 6).alias("std"))


def usual(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of at least three payloads; payloads of other lengths are compared with the nearest of these."""
    return payl.payload_centroids(payloads(spark, d), "text").where("n >= 3")


@query(BYTES + NEAREST + "SELECT doc_id, near_length FROM r WHERE k = 1")
def q_payl_nearest(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("protocol"), F.col("source").alias("port"), (F.floor(F.col("n_chars") / 500) * 500).alias("length"))
    lengths = rows.groupBy(*payl.KEY).agg(F.count("*").alias("n")).where("n >= 3")
    return payl.nearest_centroid(rows, lengths, ["doc_id"], [])


def distances(spark: SparkSession, d: str) -> DataFrame:
    return payl.payload_distances(payloads(spark, d), usual(spark, d), ["doc_id", "protocol"], "text")


@query(BYTES + NEAREST + "SELECT doc_id, protocol, round(distance, 4) AS distance FROM g")
def q_payl_distance(spark, d):
    return rounded(distances(spark, d))


@query(BYTES + NEAREST + "SELECT protocol, round(avg(distance), 4) AS mean_payl_dist, round(min(distance), 4) AS min_payl_dist, round(max(distance), 4) AS max_payl_dist, round(stddev_pop(distance), 4) AS std_payl_dist FROM g GROUP BY ALL")
def q_payl_flow_agg(spark, d):
    return rounded(payl.flow_distances(distances(spark, d), ["protocol"]))


@query(BYTES + ", n AS (SELECT DISTINCT protocol, port, length, lead(length) OVER (PARTITION BY protocol, port ORDER BY length) AS next_length FROM (SELECT DISTINCT protocol, port, length FROM c)) SELECT n.*, round(sum(abs(a.mean - b.mean)), 4) AS distance FROM n JOIN c a USING (protocol, port, length) JOIN c b ON b.protocol = n.protocol AND b.port = n.port AND b.length = n.next_length AND b.byte = a.byte GROUP BY ALL")
def q_payl_neighbours(spark, d):
    return rounded(payl.neighbour_distances(payl.payload_centroids(payloads(spark, d), "text")))


@query()
def q_payl_clusters(spark, d):
    return payl.cluster(payl.payload_centroids(payloads(spark, d), "text"), 0.4).select("protocol", "port", "length", "n")


@query("SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END AS event_type_ohe_{v}" for v in ("click", "error", "purchase", "signup", "view")) + " FROM events")
def q_onehot(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return transformers.one_hot(rows, "event_type", transformers.vocabulary(rows, "event_type"))


@query(S[:-2] + " SELECT user_id, flow_seq, round(sum(length), 4) AS fwd_sum_pkt_length, count(length) AS fwd_n_packets FROM s GROUP BY ALL")
def q_feature_filter(spark, d):
    stats = flows.length_stats(flow_packets(spark, d), FLOW, prefix="fwd")
    return rounded(transformers.keep_features(stats, [*FLOW, "fwd_sum_pkt_length", "fwd_n_packets"]))


MATRIX = "WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) "


@query(MATRIX + ", s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM u GROUP BY i) SELECT vec_id, CAST(i AS INTEGER) AS i, round((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 4) AS z FROM u JOIN s USING (i)")
def q_standard_scale(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    z = transformers.standard_scaler(rows).column(F.col("features"))
    return rows.select("vec_id", F.posexplode(z).alias("i", "z")).select("vec_id", "i", F.round("z", 4).alias("z"))


@query(MATRIX + ", s AS (SELECT i, min(x) AS lo, max(x) AS hi FROM u GROUP BY i) SELECT vec_id, CAST(i AS INTEGER) AS i, round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 4) AS z FROM u JOIN s USING (i)")
def q_minmax_scale(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    z = transformers.minmax_scaler(rows).column(F.col("features"))
    return rows.select("vec_id", F.posexplode(z).alias("i", "z")).select("vec_id", "i", F.round("z", 4).alias("z"))


@query()
def q_pca_variance(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return rows.select("vec_id", transformers.pca(rows, 10).column(F.col("features")).alias("pca"))


@query("WITH n AS (SELECT vec_id, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS v FROM embeddings), t AS (SELECT quantile_cont(v, 0.95) AS t FROM n) SELECT vec_id, CASE WHEN v > t THEN 1 ELSE 0 END AS label FROM n, t")
def q_threshold_percentile(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return engines.over_percentile(table(spark, d, "embeddings").select("vec_id", norm.alias("v")), "v", 0.95).select("vec_id", "label")


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS point_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS rank FROM p) SELECT query_id, CAST(rank AS INTEGER) AS rank, round(distance, 4) AS distance FROM r WHERE rank <= 5""")
def q_knn(spark, d):
    points = table(spark, d, "embeddings")
    return rounded(neighbours.knn(points.where("vec_id % 50 = 0"), points, 5).select("query_id", "rank", "distance"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS i, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, i) AS k FROM p), n AS (SELECT * FROM r WHERE k <= 20), reach AS (SELECT q AS i, max(d) AS reach FROM n GROUP BY q),
 dens AS (SELECT n.q AS i, 1 / (avg(greatest(d, reach)) + 1e-10) AS density FROM n JOIN reach USING (i) GROUP BY n.q), s AS (SELECT q, i, d FROM n WHERE k < 20 UNION ALL SELECT vec_id, vec_id, 0 FROM e),
 o AS (SELECT s.q AS vec_id, avg(density) * (avg(greatest(d, reach)) + 1e-10) AS score FROM s JOIN reach USING (i) JOIN dens USING (i) GROUP BY s.q) SELECT vec_id, round(score, 6) AS score, CASE WHEN score > 1.5 THEN 1 ELSE 0 END AS label FROM o""")
def q_lof(spark, d):
    return rounded(neighbours.local_outlier_factor(_matrix(spark, d), "vec_id", "features").withColumn("label", (F.col("score") > 1.5).cast("int")), 6)


@query()
def q_isolation_forest(spark, d):
    rows = _matrix(spark, d)
    forest = engines.isolation_forest(rows, "vec_id", "features")
    return engines.score_rows(rows, "vec_id", "features", forest).withColumn("label", (F.col("score") > 0.5).cast("int"))


@query()
def q_one_class_svm(spark, d):
    rows = _matrix(spark, d)
    svm = fitting.fit_one_class_svm(rows, "vec_id", "features", nu=0.05, gamma=0.5)
    return engines.score_rows(rows, "vec_id", "features", svm).withColumn("label", (F.col("score") < 0).cast("int"))


@query()
def q_autoencoder(spark, d):
    rows = _matrix(spark, d)
    auto = fitting.fit_autoencoder(rows, "vec_id", "features", epochs=10)
    return engines.over_percentile(engines.score_rows(rows, "vec_id", "features", auto), "score", 0.99)


@query("""
WITH g AS (SELECT CAST(row_number() OVER (ORDER BY a.k, b.k, c.k) - 1 AS INTEGER) AS "index", a.v AS de_nu, b.v AS fe_timeout, c.v AS transformers
    FROM (VALUES (0, '0.1'), (1, '0.2')) a(k, v), (VALUES (0, '120'), (1, '600')) b(k, v), (VALUES (0, 'minmax_scaler'), (1, 'minmax_scaler,onehot_encoder')) c(k, v)),
n AS (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), ts) AS gap, value FROM events)
SELECT "index", de_nu, fe_timeout, transformers, count_if(gap IS NULL OR gap > CAST(fe_timeout AS INTEGER) * 1000000) AS n_flows, count_if(value > CAST(de_nu AS DOUBLE) * 1000) AS n_over FROM g, n GROUP BY ALL""")
def q_hyperparam_grid(spark, d):
    """Each combination applied to all events: the flows that its timeout makes, and the values over its share of 1,000."""
    grid = reporting.grid(spark, {"nu": [0.1, 0.2]}, {"timeout": [120, 600]}, [["minmax_scaler"], ["minmax_scaler", "onehot_encoder"]])
    gap = F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy("user_id").orderBy("pkt_idx"))
    rows = packets(spark, d).select("length", gap.alias("gap"))
    combos = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, grid.dtypes)]) for r in grid.collect()]
    tried = rows.withColumn("g", F.explode(F.array(*combos)))
    return tried.groupBy("g").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > F.col("g.fe_timeout").cast("int") * 1_000_000)).alias("n_flows"), F.count_if(F.col("length") > F.col("g.de_nu").cast("double") * 1000).alias("n_over")).select("g.*", "n_flows", "n_over")


@query(VERDICTS + f"SELECT part, seq, row_number() OVER (PARTITION BY part ORDER BY seq) AS place, tp, fp FROM (SELECT part, seq, {_COUNTS} FROM v GROUP BY ALL)")
def q_hyperparam_groups(spark, d):
    counts = evaluation.confusion(verdicts(spark, d), ["part", "seq"])
    groups = reporting.hyperparam_groups(counts, "seq", ["part"], ["tp", "fp"])
    return groups.select("part", F.posexplode("series").alias("at", "s")).select("part", "s.seq", (F.col("at") + 1).cast("long").alias("place"), "s.tp", "s.fp")


@query(VERDICTS + f""", c AS (SELECT part, seq, {_COUNTS} FROM v GROUP BY ALL), m AS (SELECT part, seq, 'tp' AS metric, tp AS value FROM c UNION ALL SELECT part, seq, 'fn', fn FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY part, metric ORDER BY value DESC, seq) AS rank FROM m) SELECT part, seq, metric, value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def q_report_topk(spark, d):
    return reporting.top_by_metric(evaluation.confusion(verdicts(spark, d), ["part", "seq"]), ["part"], ["tp", "fn"], ["seq"], 3)


@query("SELECT event_id, user_id FROM events")
def q_report_constants(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.lit(1).alias("fixed"), F.lit(None).cast("int").alias("empty"))
    return rows.drop(*reporting.constant_columns(rows, ["user_id", "fixed", "empty"]))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS scaler, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS encoder FROM events")
def q_transformer_indicators(spark, d):
    names = F.expr("CASE event_type WHEN 'click' THEN 'scaler' WHEN 'view' THEN 'scaler,encoder' ELSE '' END")
    return reporting.transformer_indicators(table(spark, d, "events").select("event_id", names.alias("transformers")), ["scaler", "encoder"]).drop("transformers")


@query("SELECT c.c_custkey, count(o.o_orderkey) AS n_results FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL")
def q_classification_counts(spark, d):
    return store.with_counts(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o.o_orderkey, c.c_custkey, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
def q_evaluations_join(spark, d):
    results = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("classification_id"))
    info = table(spark, d, "customer").select(F.col("c_custkey").alias("classification_id"), F.col("c_nationkey").alias("model_id"))
    models = table(spark, d, "nation").select(F.col("n_nationkey").alias("model_id"), F.col("n_name").alias("decision_engine"), F.lit("").alias("feature_extractor"), F.lit("").alias("transformers"))
    return store.with_models(results, info, models).select("o_orderkey", F.col("classification_id").alias("c_custkey"), F.col("decision_engine").alias("n_name"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1000 * (o_totalprice - 1) / (o_orderkey % 5) END, 2) AS ms FROM orders")
def q_ms_per_packet(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("m").alias("model_id"), F.col("o_orderkey").alias("classification_id"), F.col("o_totalprice").cast("double").alias("total_time"), F.lit(1.0).alias("packet_read_time"), (F.col("o_orderkey") % 5).cast("double").alias("packet_count"))
    model = spark.createDataFrame([("m",)], "model_id string")
    evals = rows.select("classification_id", F.lit(1).alias("is_aggregated"))
    out = reporting.evaluations_by_model(evals, rows, model)
    return out.select("o_orderkey", F.round("classification_ms_per_packet", 2).alias("ms"))


@query("SELECT event_id FROM events WHERE event_id < 20 OR event_id BETWEEN 100 AND 199 OR event_id >= 900")
def q_packet_range_subset(spark, d):
    return pcap.subset(table(spark, d, "events"), [(0, 20), (100, 200), (900, "end")], "event_id").select("event_id")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src7')")
def q_file_range_select(spark, d):
    names = pcap.select_files([f"src{i}" for i in range(1, 20)], ["1-3", "7"])
    return table(spark, d, "documents").where(F.col("source").isin(names)).select("doc_id", "source")


CAPTURED = """WITH p AS (SELECT *, event_id AS pkt_idx, epoch_us(ts) AS ts_us, 100000 + user_id AS usr, 200000 + user_id % 7 AS srv, 1000 + user_id % 50 AS uport, event_type IN ('click', 'view', 'signup') AS out, CASE WHEN user_id % 3 = 0 THEN 17 ELSE 6 END AS protocol FROM events),
 q AS (SELECT pkt_idx, ts_us, CASE WHEN out THEN usr ELSE srv END AS src_ip, CASE WHEN out THEN srv ELSE usr END AS dst_ip, CASE WHEN out THEN uport ELSE 80 END AS src_port, CASE WHEN out THEN 80 ELSE uport END AS dst_port, protocol, pkt_idx % 64 AS ttl,
  CAST(floor(value * 10) AS BIGINT) + 8 AS l4_len, CASE WHEN protocol = 6 THEN CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 18 WHEN 'click' THEN 16 WHEN 'view' THEN 24 ELSE 17 END END AS flags, CASE WHEN protocol = 6 THEN pkt_idx % 1000 END AS win, usr, props FROM p), """


def captured(spark: SparkSession, d: str) -> DataFrame:
    e = packets(spark, d, "props")
    usr, srv, uport, out = F.col("user_id") + 100_000, F.col("user_id") % 7 + 200_000, (F.col("user_id") % 50 + 1000).cast("int"), F.col("event_type").isin("click", "view", "signup")
    pick = lambda a, b: F.when(out, a).otherwise(b)
    proto = F.when(F.col("user_id") % 3 == 0, 17).otherwise(6)
    flags = F.expr("CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 18 WHEN 'click' THEN 16 WHEN 'view' THEN 24 ELSE 17 END")
    tcp = lambda c: F.when(proto == 6, c)
    return e.select(
        F.lit("events").alias("file"), "pkt_idx", "ts_us", pick(usr, srv).alias("src_ip"), pick(srv, usr).alias("dst_ip"), pick(uport, F.lit(80)).alias("src_port"), pick(F.lit(80), uport).alias("dst_port"), proto.alias("protocol"), (F.col("pkt_idx") % 64).cast("int").alias("ttl"),
        (F.floor(F.col("length") * 10) + 28).alias("ip_len"), (F.floor(F.col("length") * 10) + 8).alias("l4_len"), tcp(flags).alias("tcp_flags"), tcp(F.col("pkt_idx") % 1000).alias("tcp_win"), F.encode("props", "utf-8").alias("payload"),
    )


SETTINGS = extractors.FlowSettings(frozenset({"subflows", "tcp", "hindsight", "with_ip_addr"}), TIMEOUT, SUBFLOW)
SHORT_FLOWS = extractors.FlowSettings(frozenset(), TIMEOUT, SUBFLOW)


def _flows_sql(tcp: bool) -> str:
    """Packets of CAPTURED with their flow: w (user and sequence), whether it is forward, gaps and the handshake's packets."""
    boundary = f"ts_us - lag(ts_us) OVER k > {TIMEOUT}"
    if tcp:
        boundary = f"CASE WHEN flags IS NOT NULL THEN flags & 1 = 1 ELSE {boundary} END"
    return CAPTURED + f"""n AS (SELECT *, CASE WHEN lag(ts_us) OVER k IS NULL OR {boundary} THEN 1 ELSE 0 END AS new FROM q WINDOW k AS (PARTITION BY usr ORDER BY pkt_idx)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY usr ORDER BY pkt_idx ROWS UNBOUNDED PRECEDING) AS seq FROM n),
 fw AS (SELECT *, src_ip = first_value(src_ip) OVER w AS forward, first_value(pkt_idx) OVER w AS flow_first, (ts_us - lag(ts_us) OVER w) / 1e6 AS gap, (lead(ts_us) OVER w - ts_us) / 1e6 AS next_gap FROM s WINDOW w AS (PARTITION BY usr, seq ORDER BY pkt_idx)),
 og AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY usr, seq, forward ORDER BY pkt_idx)) / 1e6 AS own_gap, max(CASE WHEN gap IS NULL OR gap > {SUBFLOW / 1e6} THEN ts_us END) OVER (PARTITION BY usr, seq ORDER BY pkt_idx ROWS UNBOUNDED PRECEDING) AS sub_start FROM fw),
 h1 AS (SELECT *, min(CASE WHEN flags & 18 = 2 THEN pkt_idx END) OVER (PARTITION BY usr, seq) AS ia FROM og), h2 AS (SELECT *, max(CASE WHEN pkt_idx = ia THEN src_ip END) OVER (PARTITION BY usr, seq) AS who FROM h1),
 h3 AS (SELECT *, min(CASE WHEN flags & 18 = 18 AND pkt_idx > ia AND dst_ip = who THEN pkt_idx END) OVER (PARTITION BY usr, seq) AS ib FROM h2), h AS (SELECT *, min(CASE WHEN flags & 18 = 16 AND pkt_idx > ib AND src_ip = who THEN pkt_idx END) OVER (PARTITION BY usr, seq) AS ic FROM h3) """


def _extractor_sql() -> str:
    limit = SUBFLOW / 1e6
    cols = []
    r = lambda v, name, none="-1": cols.append(f"round(coalesce({v}, {none}), {9 if name.startswith('mean_') else 7}) AS {name}")
    n = lambda v, name: cols.append(f"CAST({v} AS BIGINT) AS {name}")
    for d, own, gap in (("total", "true", "gap"), ("fwd", "forward", "own_gap"), ("bwd", "NOT forward", "own_gap")):
        on = f"FILTER ({own})"
        n(f"coalesce(sum(l4_len) {on}, -1)", f"{d}_sum_pkt_length")
        r(f"avg(l4_len) {on}", f"{d}_mean_pkt_length")
        n(f"coalesce(min(l4_len) {on}, -1)", f"{d}_min_pkt_length")
        n(f"coalesce(max(l4_len) {on}, -1)", f"{d}_max_pkt_length")
        r(f"stddev_pop(l4_len) {on}", f"{d}_std_pkt_length")
        n(f"count(*) {on}", f"{d}_n_packets")
        sec = f"coalesce(nullif((arg_max(ts_us, pkt_idx) {on} - arg_min(ts_us, pkt_idx) {on}) / 1e6, 0), 1)"
        r(f"count(*) {on} / {sec}", f"{d}_packets_per_s")
        r(f"sum(l4_len) {on} / {sec}", f"{d}_bytes_per_s")
        r(f"avg(ttl) {on}", f"{d}_avg_ttl")
        for k, f in (("std", "stddev_pop"), ("min", "min"), ("max", "max"), ("sum", "sum")):
            r(f"{f}({gap}) {on}", f"{d}_iat_{k}")
    n(f"count(*) FILTER (gap > {limit}) + 1", "n_subflows")
    for k, v, on in (("active", "(ts_us - sub_start) / 1e6", f"FILTER (next_gap IS NULL OR next_gap > {limit})"), ("idle", "gap", f"FILTER (gap > {limit})")):
        n(f"count({v}) {on}", f"n_{k}_times")
        for name, f in (("min", "min"), ("max", "max"), ("total", "sum"), ("std", "stddev_pop"), ("mean", "avg")):
            r(f"{f}({v}) {on}", f"{name}_{k}_time", "0")
    for d, own in (("fwd", "forward"), ("bwd", "NOT forward")):
        parts = f"nullif(count(*) FILTER ({own} AND (own_gap IS NULL OR own_gap > {limit})), 0)"
        r(f"count(*) FILTER ({own}) / {parts}", f"{d}_subflow_avg_pkts", "0")
        r(f"sum(l4_len) FILTER ({own}) / {parts}", f"{d}_subflow_avg_length", "0")
    for d, own in (("fwd", "forward"), ("bwd", "NOT forward")):
        r(f"avg(win) FILTER ({own})", f"tcp_{d}_win_mean")
        for name, test in (("urg", "flags & 32 > 0"), ("syn", "flags & 18 = 2"), ("syn_ack", "flags & 18 = 18"), ("ack", "flags & 18 = 16"), ("fin", "flags & 1 > 0"), ("push", "flags & 8 > 0"), ("rst", "flags & 4 > 0")):
            n(f"CASE WHEN count(flags) FILTER ({own}) = 0 THEN -1 ELSE count(*) FILTER ({own} AND {test}) END", f"tcp_{d}_total_{name}")
    at = lambda i: f"max(CASE WHEN pkt_idx = {i} THEN ts_us END)"
    for name, a, b in (("tcp_syn_synack", "ia", "ib"), ("tcp_synack_ack", "ib", "ic"), ("tcp_rtt", "ia", "ic")):
        r(f"CASE WHEN {at('ic')} IS NOT NULL THEN ({at(b)} - {at(a)}) / 1e6 END", name)
    keys = {n: ", ".join(cols) for n, cols in extractors.HINDSIGHT.items()}
    hind = ", ".join(f"count(*) OVER (PARTITION BY {k} ORDER BY flow_idx RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING) AS hindsight_{n}" for n, k in keys.items())
    return _flows_sql(True) + f""", a AS (SELECT flow_first, arg_min(src_port, pkt_idx) AS src_port, arg_min(dst_port, pkt_idx) AS dest_port, any_value(protocol) AS protocol, arg_min(src_ip, pkt_idx) AS src_ip, arg_min(dst_ip, pkt_idx) AS dest_ip, {', '.join(cols)} FROM h GROUP BY flow_first),
     i AS (SELECT *, row_number() OVER (ORDER BY flow_first) - 1 AS flow_idx FROM a) SELECT 'events' AS file, *, {hind} FROM i"""


@query(_extractor_sql())
def q_flow_extractor(spark, d):
    rows = extractors.flow_features(captured(spark, d), SETTINGS)
    return rows.select(*[F.round(c, 9 if c.startswith("mean_") else 7).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


#: Flow features in SQL alone. Flows are numbered and looked back upon by ranges, so that no task holds all of a capture or of an address.
FLOWS_SQL = f"SELECT * FROM flow_features(TABLE({{packets}}), modes => 'subflows tcp with_ip_addr', timeout => {TIMEOUT / 1e6}, subflow => {SUBFLOW / 1e6})"
FLOW_FEATURES_SQL = f"""
WITH f AS (SELECT * FROM {{flows}}),
 placed AS (SELECT *, flow_first DIV 1048576 AS span, row_number() OVER (PARTITION BY file, flow_first DIV 1048576 ORDER BY flow_first) - 1 AS place FROM f),
 spans AS (SELECT file, span, sum(count(*)) OVER (PARTITION BY file ORDER BY span) - count(*) AS before FROM placed GROUP BY file, span),
 numbered AS (SELECT placed.*, before + place AS flow_idx FROM placed JOIN spans USING (file, span)),
 dealt AS (SELECT *, flow_idx DIV 16384 AS own, explode(if(flow_idx % 16384 >= 16284, array(flow_idx DIV 16384, flow_idx DIV 16384 + 1), array(flow_idx DIV 16384))) AS part FROM numbered),
 counted AS (SELECT *, {", ".join(f"count(*) OVER (PARTITION BY file, {', '.join(cols)}, part ORDER BY flow_idx RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING) AS hindsight_{n}" for n, cols in extractors.HINDSIGHT.items())} FROM dealt)
SELECT * EXCEPT (span, place, own, part) FROM counted WHERE part = own"""


@query(_extractor_sql())
def q_flow_features_sql(spark, d):
    flow_table.register(spark)
    found = written(spark.sql(FLOWS_SQL, packets=captured(spark, d)), "flows")  # numbering reads them twice
    rows = spark.sql(FLOW_FEATURES_SQL, flows=found)
    return rows.select(*[F.round(c, 9 if c.startswith("mean_") else 7).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query(_flows_sql(True) + f""", idle AS (SELECT CASE WHEN lag(ts_us) OVER k IS NULL OR ts_us - lag(ts_us) OVER k > {TIMEOUT} THEN 1 ELSE 0 END AS new FROM q WINDOW k AS (PARTITION BY usr ORDER BY pkt_idx))
 SELECT modes, n_features, CASE WHEN modes LIKE '%tcp%' THEN by_fin ELSE by_idle END AS n_flows
 FROM (VALUES ('', 42), ('basic', 3), ('port_decimal', 56), ('with_ip_addr', 44), ('ip_dotted with_ip_addr', 74), ('subflows', 59), ('tcp', 61), ('hindsight', 48), ('basic tcp', 3)) v(modes, n_features),
 (SELECT count(*) AS by_fin FROM (SELECT DISTINCT usr, seq FROM s)), (SELECT CAST(sum(new) AS BIGINT) AS by_idle FROM idle)""")
def q_extractor_modes(spark, d):
    rows, out = captured(spark, d), []
    for modes in ("", "basic", "port_decimal", "with_ip_addr", "ip_dotted with_ip_addr", "subflows", "tcp", "hindsight", "basic tcp"):
        settings = extractors.FlowSettings(frozenset(modes.split()), TIMEOUT, SUBFLOW)
        found = extractors.flow_features(rows, settings)
        out.append(found.agg(F.count("*").alias("n_flows")).select(F.lit(modes).alias("modes"), F.lit(len(extractors.feature_names(found, settings))).alias("n_features"), "n_flows"))
    return reduce(DataFrame.unionAll, out)


@query(_flows_sql(False) + """, b AS (SELECT flow_first, ('0x' || x)::INTEGER AS byte, count(*) AS k FROM (SELECT flow_first, unnest(regexp_extract_all(hex(encode(props)), '..')) AS x FROM h) GROUP BY ALL), t AS (SELECT flow_first, sum(octet_length(encode(props))) AS total, count(*) AS n FROM h GROUP BY ALL)
 SELECT t.flow_first, t.n AS total_n_packets, byte, k / total AS freq FROM t JOIN b USING (flow_first)""")
def q_flows_payload(spark, d):
    rows = extractors.payload_flows(captured(spark, d), SHORT_FLOWS)
    freq = F.filter(F.array(*[F.struct(F.lit(i).alias("byte"), F.col(f"freq_byte_{i}").alias("freq")) for i in range(256)]), lambda b: b["freq"] > 0)
    return rows.select("flow_first", "total_n_packets", F.explode(freq).alias("b")).select("flow_first", "total_n_packets", "b.byte", "b.freq")


@query(_flows_sql(False) + """, x AS (SELECT pkt_idx, flow_first, protocol, dst_port AS port, octet_length(encode(props)) AS length, hex(encode(props)) AS hx FROM h), b AS (SELECT pkt_idx, ('0x' || y)::INTEGER AS byte, count(*) AS k FROM (SELECT pkt_idx, unnest(regexp_extract_all(hx, '..')) AS y FROM x) GROUP BY ALL),
 f AS (SELECT x.*, k, byte FROM x JOIN b USING (pkt_idx)), m AS (SELECT protocol, port, length, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT protocol, port, length, byte, sum(k / length) / any_value(m.n) AS mean, sum((k / length) * (k / length)) / any_value(m.n) AS q FROM f JOIN m USING (protocol, port, length) GROUP BY ALL),
 z AS (SELECT x.pkt_idx, x.flow_first, sum(abs(c.mean - coalesce(b.k, 0) / x.length) / (sqrt(greatest(c.q - c.mean * c.mean, 0)) + 0.1)) AS distance FROM x JOIN c USING (protocol, port, length) LEFT JOIN b ON b.pkt_idx = x.pkt_idx AND b.byte = c.byte GROUP BY ALL)
 SELECT flow_first, count(*) AS total_n_packets, round(avg(distance), 4) AS mean_payl_dist, round(min(distance), 4) AS min_payl_dist, round(max(distance), 4) AS max_payl_dist, round(stddev_pop(distance), 4) AS std_payl_dist FROM z GROUP BY ALL""")
def q_payl_flows(spark, d):
    rows = captured(spark, d)
    out = extractors.payl_flows(rows, extractors.fit_payl(rows, SHORT_FLOWS), SHORT_FLOWS, smoothing=0.1)
    return rounded(out.select("flow_first", "total_n_packets", *[f"{n}_payl_dist" for n in ("mean", "min", "max", "std")]))


@query(CAPTURED[:-2] + " SELECT pkt_idx, src_ip, dst_ip AS dest_ip, src_port, dst_port AS dest_port, CASE protocol WHEN 6 THEN 1 ELSE 0 END AS is_tcp, coalesce(flags, 0) AS tcp_flags, CASE protocol WHEN 17 THEN 1 ELSE 0 END AS is_udp, l4_len + 34 AS frame_len FROM q")
def q_packet_features(spark, d):
    rows = extractors.packet_features(captured(spark, d).withColumn("frame_len", F.col("l4_len") + 34))
    return rows.select("pkt_idx", "src_ip", "dest_ip", "src_port", "dest_port", "is_tcp", "tcp_flags", "is_udp", "frame_len")


@query(LABELLED + "SELECT CAST(dst AS VARCHAR) AS pcap, nullif(count(*) FILTER (event_type = 'error'), 0) AS error, nullif(count(*) FILTER (event_type = 'signup'), 0) AS signup, count(*) AS total, count(*) FILTER (event_type IN ('error', 'signup')) AS num_attacks, round(count(*) FILTER (event_type IN ('error', 'signup')) / count(*), 4) AS fraction_attacks FROM p GROUP BY dst")
def q_capture_stats(spark, d):
    attack = F.col("event_type").isin("error", "signup")
    rows = packets(spark, d).select(F.col("dst").cast("string").alias("pcap"), attack.cast("int").alias("traffic_type"), F.when(attack, F.col("event_type")).alias("attack_type"))
    return rounded(packet_labels.capture_stats(rows))


@query("""WITH e AS (SELECT event_type AS attack_type, count(*) AS flows, sum(2 * (event_id % 5)) AS expected FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL), a AS (SELECT event_type AS attack_type, count(*) AS actual FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL),
 b AS (SELECT attack_type, flows AS expected_flows, expected, actual FROM e JOIN a USING (attack_type) UNION ALL SELECT 'total', sum(flows), sum(expected), (SELECT sum(actual) FROM a) FROM e) SELECT attack_type, expected_flows::BIGINT AS expected_flows, expected::BIGINT AS expected, actual::BIGINT AS actual, (actual - expected)::BIGINT AS difference, round(CASE WHEN expected = 0 THEN 0.0 ELSE abs(expected - actual) / expected END, 4) AS error FROM b""")
def q_validation(spark, d):
    attack = F.col("event_type").isin("error", "signup")
    rows = packets(spark, d).select(F.col("dst").cast("string").alias("pcap"), attack.cast("int").alias("traffic_type"), F.when(attack, F.col("event_type")).alias("attack_type"), "pkt_idx")
    known = rows.select("traffic_type", F.col("attack_type").alias("info"), (F.col("pkt_idx") % 5).alias("src_packets"), (F.col("pkt_idx") % 5).alias("dest_packets"))
    return rounded(preprocess.validation(known, packet_labels.capture_stats(rows)))


@query("SELECT c_nationkey AS model_id, round(CAST(sum(c_acctbal * 2) AS DOUBLE), 2) AS total_time, round(CAST(sum(c_acctbal) AS DOUBLE), 2) AS packet_read_time, CAST(count(*) AS DOUBLE) AS packet_count FROM customer GROUP BY ALL")
def q_run_totals(spark, d):
    info = table(spark, d, "customer").select(F.col("c_nationkey").alias("model_id"), (F.col("c_acctbal").cast("double") * 2).alias("total_time"), F.col("c_acctbal").cast("double").alias("packet_read_time"), F.lit(1.0).alias("packet_count"))
    return rounded(lifecycle.run_totals(info, ["model_id"]), 2)


_PLOT = VERDICTS + f", c AS (SELECT part, seq, {_COUNTS} FROM v GROUP BY ALL), m AS (SELECT part, seq, {_sd('tp', 'tp + fn')} AS recall, {_sd('fp', 'fp + tp')} AS fdr, {_sd('tp', 'tp + fp')} AS precision FROM c) "


def plotted(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.with_metrics(evaluation.confusion(verdicts(spark, d), ["part", "seq"]))
    return rows.withColumns({"dataset_name": F.lit("d"), "traffic_name": F.lit("t"), "part_name": F.col("part")})


@query(_PLOT + "SELECT part, metric, seq, round(value, 4) AS value FROM (SELECT part, seq, 'precision' AS metric, precision AS value FROM m UNION ALL SELECT part, seq, 'recall', recall FROM m)")
def q_metric_series(spark, d):
    rows = reporting.metric_series(plotted(spark, d), "seq", ["part"], ["precision", "recall"])
    return rows.select("part", "metric", F.explode("points").alias("p")).select("part", "metric", "p.seq", F.round("p.value", 4).alias("value"))


@query(_PLOT + ", g AS (SELECT part, dense_rank() OVER (ORDER BY part) - 1 AS k FROM (SELECT DISTINCT part FROM m)) SELECT part AS part_name, seq, round(fdr, 4) AS fdr, round(recall, 4) AS recall, CAST(k // 2 + 1 AS BIGINT) AS grid_row, CAST(k % 2 + 1 AS INTEGER) AS grid_column FROM m JOIN g USING (part)")
def q_recall_points(spark, d):
    rows = reporting.recall_points(plotted(spark, d), "seq", ["part_name"], across=2)
    return rows.select("part_name", F.explode("points").alias("p"), "grid_row", "grid_column").select("part_name", "p.seq", F.round("p.fdr", 4).alias("fdr"), F.round("p.recall", 4).alias("recall"), "grid_row", "grid_column")


@query("SELECT o.o_orderkey AS classification_id, CASE WHEN length(n.n_name) > 10 THEN substr(n.n_name, 1, 10) || '..' ELSE n.n_name END AS decision_engine, 'flow_extra..' AS feature_extractor, 'all' AS part_name, 0.5 AS precision, round(CAST(o.o_totalprice AS DOUBLE), 2) AS mcc FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
def q_listed_evaluations(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = o.select("o_orderkey", F.col("o_custkey").alias("classification_id"), F.lit(1).alias("is_aggregated"), F.lit("all").alias("part_name"), F.lit(0.5).alias("precision"), F.col("o_totalprice").cast("double").alias("mcc"))
    models = n.select(F.col("n_nationkey").alias("model_id"), F.col("n_name").alias("decision_engine"), F.lit("flow_extractor").alias("feature_extractor"), F.lit("").alias("transformers"))
    joined = store.with_models(rows, c.select(F.col("c_custkey").alias("classification_id"), F.col("c_nationkey").alias("model_id")), models)
    return rounded(reporting.listed_evaluations(joined.withColumn("classification_id", F.col("o_orderkey"))), 2)


@query(VERDICTS + f""", c AS (SELECT part, seq, {_COUNTS} FROM v GROUP BY ALL)
 SELECT part, seq AS traffic_name, fp AS "FP", fn AS "FN", tp + fp + tn + fn AS "N", CASE WHEN tp + fn = 0 THEN CAST('inf' AS DOUBLE) ELSE round(tp / (tp + fn), 4) END AS "RC" FROM c WHERE fp >= 1""")
def q_report(spark, d):
    """Important metrics alone; the constant hyper-parameter and the other counts go."""
    rows = evaluation.with_metrics(evaluation.confusion(verdicts(spark, d), ["part", "seq"]))
    rows = rows.select(F.col("part").alias("PART"), F.col("seq").alias("traffic_name"), F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"), "support", F.round("recall", 4).alias("recall"), F.lit(1).alias("CONSTANT"), "npv")
    return reporting.report(rows, ["PART", "CONSTANT"], "FP >= 1")
