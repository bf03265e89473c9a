"""Ground truth: as-of and interval joins of labelled flows to packets, association by flow ids, diagnostics and statistics.

Joins go by time buckets, so that a key with a large share of all rows is dealt to as many tasks as it has buckets with rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.columns import percent_text, protocol_number

#: An hour, in microseconds.
BUCKET = 3_600_000_000
#: Names that parts() takes at most: kinds of traffic, not values that grow with the data.
MOST_PARTS = 1000


def _rank() -> Column:
    """Of flows that begin no later than a packet the latest counts; of equal starts benign wins, then the larger seq."""
    return F.struct("start_us", (F.col("traffic_type") == 0).alias("benign"), "seq", "traffic_type", "info")


def _last_start(packets: DataFrame, flows: DataFrame, on: list[str], best: str, bucket_us: int) -> DataFrame:
    """packets with the column best: the _rank() of the last flow of equal `on` that starts at or before them.

    Inside a bucket flows and packets are put in order and the last flow is carried on; what earlier buckets hand over comes from one row a bucket.
    """
    flows = flows.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in on]))
    bucket = lambda t: F.floor(F.col(t) / bucket_us)
    theirs = flows.select(*on, F.col("start_us").alias("at"), _rank().alias("flow"))
    ours = packets.select(*on, F.col("ts_us").alias("at"), F.struct(*packets.columns).alias("packet"))
    rows = ours.unionByName(theirs, allowMissingColumns=True).withColumn("bucket", bucket("at"))
    order = Window.partitionBy(*on, "bucket").orderBy("at", F.col("packet").isNotNull(), "flow").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last("flow", ignorenulls=True).over(order)).where(F.col("packet").isNotNull())
    both = ours.select(*on, bucket("at").alias("bucket"), F.lit(None).cast(dict(theirs.dtypes)["flow"]).alias("flow")).unionByName(theirs.select(*on, bucket("at").alias("bucket"), "flow"))
    ends = both.groupBy(*on, "bucket").agg(F.max("flow").alias("flow"))
    earlier = Window.partitionBy(*on).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.last("flow", ignorenulls=True).over(earlier)).select(*[F.col(c).alias(f"__{c}") for c in on], F.col("bucket").alias("__bucket"), "before")
    same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(ends[f"__{c}"]) for c in on]) & (rows["bucket"] == ends["__bucket"])
    return rows.join(ends, same, "left").select("packet.*", F.coalesce("own", "before").alias(best))


def dyadic_nodes(start: str, end: str, bucket_us: int) -> Column:
    """The fewest aligned ranges of 2^level buckets (level, node) that hold the buckets from start to end and no others: two a level at most."""
    first, past = F.floor(F.col(start) / bucket_us), F.floor(F.col(end) / bucket_us) + 1
    levels = F.sequence(F.lit(0), F.ceil(F.log2(past - first + 1)).cast("int"))
    size = lambda level: F.pow(F.lit(2.0), level).cast("long")

    def at(level: Column) -> Column:
        low, high = F.floor((first + size(level) - 1) / size(level)), F.floor(past / size(level))
        node = lambda n, odd: F.when((low < high) & (odd.bitwiseAND(F.lit(1).cast("long")) == 1), F.struct(level.alias("level"), n.cast("long").alias("node")))
        return F.array(node(low, low), node(high - 1, high))

    return F.array_compact(F.flatten(F.transform(levels, at)))


def _by_nodes(rows: DataFrame, at: str, levels: list[int], bucket_us: int) -> DataFrame:
    """rows once for each level, with the node (__level, __node) that their time lies in."""
    bucket = F.floor(F.col(at) / bucket_us)
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(bucket / F.lit(1 << k)).alias("node")) for k in levels])
    return rows.withColumn("__n", F.explode(nodes)).withColumns({"__level": F.col("__n.level"), "__node": F.col("__n.node")}).drop("__n")


def _open_flow(packets: DataFrame, flows: DataFrame, on: list[str], source: str | None, bucket_us: int) -> DataFrame:
    """packets with __best: the _rank() of the last flow that is open at their time.

    A flow is sent to the dyadic nodes that its buckets make up, two for each power of two at most, so that a wrong end time costs some rows and not one an hour. Packets
    look into the nodes that hold them, of the levels that flows have."""
    right = flows.where("end_us >= start_us").select(*[F.col(c).alias(f"__{c}") for c in on], F.explode(dyadic_nodes("start_us", "end_us", bucket_us)).alias("__n"), _rank().alias("__flow"), F.col("end_us").alias("__end"), *([F.col(source).alias("__source")] if source else []))
    levels = sorted(r[0] for r in right.select("__n.level").distinct().collect()) or [0]  # one for each power of two at most
    right = right.withColumns({"__r_level": F.col("__n.level"), "__r_node": F.col("__n.node")}).drop("__n")
    left = _by_nodes(packets, "ts_us", levels, bucket_us)
    same = [left[c] == right[f"__{c}"] for c in on] + [left["__level"] == right["__r_level"], left["__node"] == right["__r_node"], right["__flow.start_us"] <= left["ts_us"], right["__end"] >= left["ts_us"]]
    if source:
        same.append(right["__source"].isNull() | (right["__source"] == left[source]))
    return left.join(right, same, "left").groupBy(*packets.columns).agg(F.max("__flow").alias("__best"))


def asof_labels(packets: DataFrame, flows: DataFrame, on: str | list[str], use_end: bool = False, source: str | None = None, bucket_us: int = BUCKET) -> DataFrame:
    """Each packet with the flow of the latest start at or before it, whose end (if use_end) is not before it.

    packets: pkt_idx (unique), ts_us and on; flows: start_us, end_us, traffic_type, info, seq and on. Expired later flows give way to an earlier one that
    is open; flows that end before they start are never open. Of equal starts benign wins, then the larger seq. source: flows with a source match packets of this
    source only. Without a match, or with a null key, the packet is benign and matched is false.
    """
    on = [on] if isinstance(on, str) else on
    if use_end:
        found = _open_flow(packets, flows, on, source, bucket_us)
    elif source:
        found = _last_start(packets, flows.where(F.col(source).isNull()), on, "__any", bucket_us)
        found = _last_start(found, flows.where(F.col(source).isNotNull()), [*on, source], "__own", bucket_us).withColumn("__best", F.greatest("__any", "__own"))
    else:
        found = _last_start(packets, flows, on, "__best", bucket_us)
    best = F.col("__best")
    return found.select(*packets.columns, F.coalesce(best["traffic_type"], F.lit(0)).alias("traffic_type"), F.when(best["traffic_type"] == 1, best["info"]).alias("attack_type"), best.isNotNull().alias("matched"))


def associate(packets: DataFrame, flows: DataFrame, use_end: bool = False, unidirectional: bool = True, bucket_us: int = BUCKET) -> DataFrame:
    """packets with traffic_type, attack_type and diagnosis (no_flow_id, no_flow or null), by flow id or reverse id.

    packets: packet_id (unique), ts_us, flow_id, reverse_id (both null without an id), src_ip, src_port. flows: flow_id, reverse_id, start_us, end_us, info, traffic_type,
    src_ip, src_port, src_packets, dest_packets. Only attack flows and benign flows of their ids are looked at: a packet whose ids
    are of no attack is benign. unidirectional: a flow without packets of its destination matches packets of its source alone.
    """
    attack, benign = flows.where("traffic_type = 1"), flows.where("traffic_type = 0")
    near = relevant_flows(attack, benign).dropDuplicates().withColumn("seq", F.xxhash64("end_us", "info", "src_ip", "src_port"))
    one_way = (F.col("src_packets") > 0) & (F.col("dest_packets") == 0)
    near = near.withColumn("from", F.when(one_way, F.concat_ws(":", "src_ip", "src_port")) if unidirectional else F.lit(None).cast("string"))
    ids = attack.select(F.col("flow_id").alias("key")).distinct()
    keyed = packets.select("packet_id", "ts_us", F.concat_ws(":", "src_ip", "src_port").alias("from"), F.explode(F.array_compact(F.array_distinct(F.array("flow_id", "reverse_id")))).alias("key"))
    suspect = keyed.join(keyed.join(ids, "key", "left_semi").select("packet_id").distinct(), "packet_id", "left_semi")
    theirs = near.withColumnRenamed("flow_id", "key").select("key", "start_us", "end_us", "traffic_type", "info", "seq", "from")
    if use_end:
        found = _open_flow(suspect, theirs, ["key"], "from", bucket_us)
    else:
        found = _last_start(suspect, theirs.where(F.col("from").isNull()), ["key"], "any", bucket_us)
        found = _last_start(found, theirs.where(F.col("from").isNotNull()), ["key", "from"], "own", bucket_us).withColumn("__best", F.greatest("any", "own"))
    best = found.groupBy("packet_id").agg(F.max("__best").alias("__best"))
    out = packets.join(best.withColumn("__suspect", F.lit(True)), "packet_id", "left")
    flow = F.col("__best")
    diagnosis = F.when(F.col("flow_id").isNull(), "no_flow_id").when(F.col("__suspect") & flow.isNull(), "no_flow")
    return out.select(*packets.columns, F.coalesce(flow["traffic_type"], F.lit(0)).alias("traffic_type"), F.when(flow["traffic_type"] == 1, flow["info"]).alias("attack_type"), diagnosis.alias("diagnosis"))


def relevant_flows(attack: DataFrame, benign: DataFrame, on: str = "flow_id", reverse: str = "reverse_id") -> DataFrame:
    """All attack flows and the benign flows that share an id, in either direction, with one."""
    ids = attack.select(F.col(on).alias("__id")).union(attack.select(F.col(reverse).alias("__id"))).distinct()
    return attack.unionByName(benign.join(ids, benign[on] == ids["__id"], "left_semi"))


def duplicate_flows(flows: DataFrame, on: str, bucket_us: int = BUCKET) -> DataFrame:
    """Pairs (first_seq, second_seq) of one key that start together or overlap; flows that end before they start are left out.

    A pair meets in the one dyadic node of the earlier flow that holds the start of the later. For the number of a flow's duplicates without the pairs see overlaps().
    """
    ok = flows.where("end_us >= start_us").select(F.col(on).alias("k"), "start_us", "end_us", "seq")
    a = ok.withColumn("__n", F.explode(dyadic_nodes("start_us", "end_us", bucket_us))).withColumn("bucket", F.struct("__n.level", "__n.node"))
    levels = sorted(r[0] for r in a.select("__n.level").distinct().collect()) or [0]
    a = a.drop("__n").alias("a")
    b = _by_nodes(ok, "start_us", levels, bucket_us).withColumn("bucket", F.struct(F.col("__level").alias("level"), F.col("__node").alias("node"))).alias("b")
    later = (F.col("b.start_us") > F.col("a.start_us")) | ((F.col("b.start_us") == F.col("a.start_us")) & (F.col("b.seq") > F.col("a.seq")))
    hit = (F.col("b.start_us") < F.col("a.end_us")) | (F.col("b.start_us") == F.col("a.start_us"))
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.bucket") == F.col("b.bucket")) & later & hit).select(F.col("a.k").alias(on), F.col("a.seq").alias("first_seq"), F.col("b.seq").alias("second_seq"))


def _running(events: DataFrame, on: str, bucket_us: int, sums: list[str], greatest: list[str]) -> DataFrame:
    """events (on, at, order) with running sums of some columns and running maxima of others over the events of their key before them, in the order of (at, order).

    Equal (at, order) count as one moment, that none of them has behind it. Keys are dealt by time: inside a bucket by a window, between buckets by one row each.
    """
    rows = events.withColumn("__b", F.floor(F.col("at") / bucket_us))
    ends = rows.groupBy(on, "__b").agg(*[F.sum(c).alias(f"__{c}") for c in sums], *[F.max(c).alias(f"__{c}") for c in greatest])
    earlier = Window.partitionBy(on).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col(on).alias("__on"), F.col("__b").alias("__at"), *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__before_{c}") for c in sums], *[F.max(f"__{c}").over(earlier).alias(f"__before_{c}") for c in greatest])
    moment = F.struct("at", "order")
    inside = Window.partitionBy(on, "__b").orderBy("__place").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__place", F.dense_rank().over(Window.partitionBy(on, "__b").orderBy(moment)))
    rows = rows.withColumns({f"__in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums} | {f"__in_{c}": F.max(c).over(inside) for c in greatest})
    rows = rows.join(before, rows[on].eqNullSafe(before["__on"]) & (rows["__b"] == before["__at"]))
    done = {f"before_{c}": F.col(f"__in_{c}") + F.col(f"__before_{c}") for c in sums} | {f"before_{c}": F.greatest(f"__in_{c}", f"__before_{c}") for c in greatest}
    return rows.withColumns(done).select(*events.columns, *done)


def overlaps(flows: DataFrame, on: str, bucket_us: int = BUCKET) -> DataFrame:
    """Of each flow of `on`, seq: n_overlaps, with how many flows of its key it starts together or overlaps, and group_us, the start of the first flow of the chain of overlaps it is in.

    A sweep over starts and ends, so pairs are never made and no task holds a key beyond a bucket. Flows that end before they start are left out; seq is unique in its key.
    """
    ok = flows.where("end_us >= start_us").select(on, "start_us", "end_us", "seq")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # at one moment: ends, then questions for what came before, then starts, then questions that count the starts of the moment
    event = lambda at, order, begun, ended, name: ok.select(on, F.col(at).alias("at"), F.lit(order).alias("order"), begun.alias("begun"), ended.alias("ended"), F.lit(name).alias("what"), "seq", "start_us", "end_us")
    lasting = F.when(F.col("end_us") > F.col("start_us"), one).otherwise(none)
    events = event("end_us", 0, none, lasting, "end").unionAll(event("start_us", 1, none, none, "start?")).unionAll(event("start_us", 2, one, none, "start")).unionAll(event("start_us", 3, none, none, "together?")).unionAll(event("end_us", 1, none, none, "end?"))
    # a flow without length is over as the next moment begins
    events = events.unionAll(ok.where("end_us = start_us").select(on, F.col("start_us").alias("at"), F.lit(4).alias("order"), none.alias("begun"), one.alias("ended"), F.lit("end").alias("what"), "seq", "start_us", "end_us"))
    counted = _running(events, on, bucket_us, ["begun", "ended"], [])
    pick = lambda what, value: F.max(F.when(F.col("what") == what, value))
    b = F.col("before_begun")
    # open ones and those that start together, then those that start before its end
    n = pick("start?", b - F.col("before_ended")) + pick("together?", b) - pick("start?", b) - 1 + F.greatest(pick("end?", b) - pick("together?", b), none)
    sizes = counted.groupBy(on, "seq", "start_us", "end_us").agg(n.alias("n_overlaps"))
    # a chain begins with a start that no earlier flow reaches beyond
    reach = _running(ok.select(on, F.col("start_us").alias("at"), F.lit(0).alias("order"), "end_us", "seq", "start_us"), on, bucket_us, [], ["end_us"])
    first = reach.withColumn("begins", F.when(F.coalesce(F.col("before_end_us") <= F.col("start_us"), F.lit(True)), F.col("start_us")))
    chain = _running(first.select(on, F.col("start_us").alias("at"), F.lit(0).alias("order"), "begins", "seq"), on, bucket_us, [], ["begins"])
    groups = chain.select(F.col(on).alias("__on"), F.col("seq").alias("__seq"), F.coalesce("begins", "before_begins").alias("group_us"))
    return sizes.join(groups, sizes[on].eqNullSafe(groups["__on"]) & (sizes["seq"] == groups["__seq"])).select(on, "seq", "n_overlaps", "group_us")


def invalid_flows(flows: DataFrame) -> DataFrame:
    return flows.where("end_us < start_us")


def without_flow(packets: DataFrame, flows: DataFrame, on: str) -> DataFrame:
    return packets.join(flows.select(on).distinct(), on, "left_anti")


def attack_stats(labelled: DataFrame, by: str, categories: list[str], attack: str = "attack_type") -> DataFrame:
    """Counts per category, total, attacks and their share; categories are given so that no pass is needed to find them."""
    counts = [F.count_if(F.col(attack) == c).alias(c) for c in categories]
    hits = F.count(attack)
    return labelled.groupBy(by).agg(*counts, F.count("*").alias("total"), hits.alias("num_attacks"), (hits / F.count("*")).alias("fraction_attacks"))


def expected_actual(expected: DataFrame, actual: DataFrame, on: str) -> DataFrame:
    """difference and relative error of counts (column n on both sides); an expectation of 0 has error 0."""
    e, a = F.coalesce("e", F.lit(0)), F.coalesce("a", F.lit(0))
    both = expected.select(on, F.col("n").alias("e")).join(actual.select(on, F.col("n").alias("a")), on, "full")
    return both.select(on, e.alias("expected"), a.alias("actual"), (a - e).alias("difference"), F.when(e == 0, 0.0).otherwise(F.abs(e - a) / F.nullif(e, F.lit(0))).alias("error"))


def parts(labelled: DataFrame, ident: str, category: str, benign: Column) -> DataFrame:
    """(part_name, ident): part all, and each category's ids with all benign ids."""
    names = [r[0] for r in labelled.where(~benign).select(category).distinct().orderBy(category).limit(MOST_PARTS + 1).collect()]
    if len(names) > MOST_PARTS:
        raise ValueError(f"over {MOST_PARTS} values of {category}")
    every = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    mine = F.when(benign, every).otherwise(F.array(F.col(category)))
    return labelled.select(F.explode(F.concat(F.array(F.lit("all")), F.coalesce(mine, F.array().cast("array<string>")))).alias("part_name"), ident)


def unknown_protocols(flows: DataFrame, protocol: str = "proto") -> DataFrame:
    """Protocol names that stand for no number, with their flows."""
    name = F.lower(F.trim(F.col(protocol)))
    return flows.where(protocol_number(F.col(protocol)).isNull() & F.col(protocol).isNotNull()).groupBy(name.alias(protocol)).agg(F.count("*").alias("n"))


def without_protocols(flows: DataFrame, names: list[str], protocol: str = "proto") -> DataFrame:
    """Flows whose protocol is none of names; nulls stay."""
    return flows.where(~F.coalesce(F.lower(F.trim(F.col(protocol))).isin([n.strip().lower() for n in names]), F.lit(False)))


def require_columns(rows: DataFrame, names: list[str], keep: bool = True) -> DataFrame:
    """rows, or with keep only the named columns; missing ones are an error."""
    if missing := [n for n in names if n not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows.select(*names) if keep else rows


def split_traffic(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attack and benign rows."""
    return rows.where("traffic_type = 1"), rows.where("traffic_type = 0")


def stats_text(stats: DataFrame, key: str) -> DataFrame:
    """Statistics turned round: a row (statistic) for each column, and a column of text for each key; fractions in percent with three places, 0 for none.

    stats has a row a capture, some tens; their keys become columns.
    """
    text = lambda c: F.coalesce(percent_text(F.col(c)) if c.startswith("fraction") else F.col(c).cast("string"), F.lit("0"))
    values = [c for c in stats.columns if c != key]
    long = stats.select(key, *[text(c).alias(c) for c in values]).unpivot([key], values, "statistic", "value")
    keys = [r[0] for r in stats.select(key).orderBy(key).collect()]
    return long.groupBy("statistic").pivot(key, keys).agg(F.first("value"))


def first_diagnostics(rows: DataFrame, order: str, most: int = 20) -> DataFrame:
    return rows.orderBy(order).limit(most)


def numbered(flows: DataFrame, on: str) -> DataFrame:
    """Adds seq, the order of flows inside a key by start."""
    return flows.withColumn("seq", F.row_number().over(Window.partitionBy(on).orderBy("start_us", "end_us")))
