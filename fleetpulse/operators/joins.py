"""Enrichment, attribution and alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from fleetpulse.durations import micros
from fleetpulse.functions.text import encode_labels
from fleetpulse.operators.chunks import DEFAULT_CHUNK, asof_join

# Key classes an ethtool event may claim on any interface, and
# the classes only a steering event may claim.
ETHTOOL_CLASSES = ("ring", "channels", "coalesce", "rss", "msix")
STEERING_CLASSES = ("rps", "xps", "irq")


def enrich_context(df: DataFrame, context: DataFrame, keys: Sequence[str] = ("iface",),
                   columns: Sequence[str] = ("driver", "mtu"), context_ts: str = "ts",
                   chunk=DEFAULT_CHUNK) -> DataFrame:
    """Add the context valid at observation time as labels, '' when unknown."""
    right = context.select(*keys, F.col(context_ts).alias("__valid"), *columns)
    out = asof_join(df, right, keys, "ts", "__valid", columns, chunk)
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def _claims(key):
    """Candidate (priority, scope, arg) claims of a configuration key, most specific first."""
    parts = F.split(key, r"\.")
    head = parts[0]
    rest = F.substring(key, F.lit(len("sysctl.") + 1), F.length(key))

    def claim(priority, scope, arg):
        return F.struct(F.lit(priority).alias("priority"), F.lit(scope).alias("scope"),
                        F.coalesce(arg, F.lit("")).alias("arg"))

    # A written file claims the keys that start with its name or end in ".name":
    # listing both families turns the theta condition into an equality.
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(rest), F.lit(1))),
                           lambda n: claim(1, "sysctl", F.substring(rest, F.lit(1), n)))
    words = F.split(rest, r"\.")
    suffixes = F.when(F.size(words) > 1, F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))),
        lambda n: claim(1, "sysctl", F.array_join(F.slice(words, n, F.size(words)), ".")))).otherwise(
        F.array().cast("array<struct<priority:int,scope:string,arg:string>>"))
    nothing = F.lit(None).cast("string")
    iface = F.try_element_at(parts, F.lit(2))
    return (F.when(F.startswith(key, F.lit("sysctl.")), F.array_distinct(F.concat(prefixes, suffixes)))
            .when(head.isin(*STEERING_CLASSES) & (F.size(parts) > 1), F.array(claim(1, "steering", nothing)))
            .otherwise(F.filter(F.array(
                F.when(iface.isNotNull(), claim(1, "iface", iface)),
                F.when(head.isin(*ETHTOOL_CLASSES) & (F.size(parts) > 1), claim(2, "ethtool_any", nothing)),
                F.when((head == "mtu") & (F.size(parts) > 1), claim(3, "link", nothing))), lambda c: c.isNotNull())))


def normal_arg():
    """What an event's claim is compared by: the argument of those scopes that name one, else ''."""
    return F.when(F.col("scope").isin("sysctl", "iface"), F.coalesce("arg", F.lit(""))).otherwise(F.lit(""))


def attribute_changes(changes: DataFrame, events: DataFrame, window: Sequence[str] = ("window_id",),
                      key: str = "key") -> DataFrame:
    """Name the process behind each change: pid, comm; 0 and 'unknown' if nobody can claim it.

    Events are first reduced to the earliest per (window, scope, argument). Who claims a key depends on
    (window, key) alone, so only these are expanded into claims and shuffled; changes of any columns, equal
    ones included, then take the answer of theirs.
    """
    window = list(window)
    first = (events.withColumn("arg", normal_arg()).where((F.col("scope") != "sysctl") | (F.col("arg") != ""))
             .groupBy(*window, "scope", "arg")
             .agg(F.min_by(F.struct("pid", "comm"), "seq").alias("__who"), F.min("seq").alias("__seq")))
    asked = changes.select(*window, F.col(key).alias("__key")).where(F.col("__key").isNotNull()).distinct()
    claims = asked.select(*window, "__key", F.explode(_claims(F.col("__key"))).alias("__claim")).select(
        *window, "__key", F.col("__claim.priority").alias("__priority"), F.col("__claim.scope").alias("scope"), F.col("__claim.arg").alias("arg"))
    hits = claims.join(first, [*window, "scope", "arg"])
    found = hits.groupBy(*window, "__key").agg(F.min_by("__who", F.struct("__priority", "__seq")).alias("__who"))
    named = changes.withColumn("__key", F.col(key)).join(found, [*window, "__key"], "left")
    return named.select(*changes.columns, F.coalesce(F.col("__who.pid"), F.lit(0)).alias("pid"),
                        F.coalesce(F.col("__who.comm"), F.lit("unknown")).alias("comm"))


def stamp_changes(changes: DataFrame, pid: int, comm: str) -> DataFrame:
    """The polling path: every change carries the same origin."""
    return changes.withColumns({"pid": F.lit(pid), "comm": F.lit(comm)})


def annotate(df: DataFrame, changes: DataFrame, before="60 s", after="60 s", keys: Sequence[str] = (),
             change_ts: str = "change_ts") -> DataFrame:
    """Pair observations with the changes within ``[change - before, change + after]``.

    Time is cut into cells as wide as the span: a change falls in at most two
    (three at an exact edge), an observation in one, so the join hashes on the cell.
    """
    keys, b, a = list(keys), micros(before), micros(after)
    width = max(a + b, 1)
    at, when = F.unix_micros("ts"), F.unix_micros(change_ts)

    def cell(us):
        return us - F.pmod(us, F.lit(width))

    cells = F.sequence(cell(when - b), cell(when + a), F.lit(width).cast("bigint"))
    spans = changes.withColumn("__cell", F.explode(cells))
    rows = df.withColumn("__cell", cell(at))
    inside = (at >= when - b) & (at <= when + a)
    return rows.join(spans, [*keys, "__cell"]).where(inside).drop("__cell")


def _span_sums(df: DataFrame, spans: DataFrame, keys: Sequence[str], series: Sequence[str], value: str,
               pane: int) -> DataFrame:
    """Partial sums and counts of every span ``[__lo, __hi)`` (microseconds), per series met in it.

    Time is cut into panes no longer than a span. Panes wholly inside a span are summed once and looked up;
    in its two edge panes the span's borders are sorted in among the rows, so a border reads a running
    sum from its side of the pane: no row is paired with a change, and nothing is subtracted.
    """
    lo, hi, at = F.col("__lo"), F.col("__hi"), F.col("__at")
    grain = [*keys, *series, "__pane"]

    def cell(us):
        return us - F.pmod(us, F.lit(pane))

    touched = spans.withColumn("__pane", F.explode(F.sequence(cell(lo), cell(hi - 1), F.lit(pane).cast("bigint"))))
    held = F.col(value) if isinstance(df.schema[value].dataType, T.DecimalType) else F.col(value).cast("double")
    rows = (df.where(F.col("ts").isNotNull())
            .select(*keys, *series, F.unix_micros("ts").alias("__at"), held.alias("__value"), F.lit(1).alias("__row"))
            .withColumn("__pane", cell(at)))
    # Rows far from any change go before the shuffle where the changes are few.
    near = rows.join(touched.select(*keys, "__pane"), [*keys, "__pane"], "left_semi")
    sums = [F.sum("__value").alias("__sum"), F.count("__value").alias("__known"), F.count("__row").alias("__n")]
    met = touched.join(near.groupBy(*grain).agg(*sums), [*keys, "__pane"])
    first, inside = F.col("__pane") < lo, (F.col("__pane") >= lo) & (F.col("__pane") + pane <= hi)
    parts = ["__span", *series, "__sum", "__known", "__n"]
    borders = met.where(~inside).select(*grain, "__span", first.alias("__first"), F.when(first, lo).otherwise(hi).alias("__at"))
    mixed = near.unionByName(borders, allowMissingColumns=True)
    upto = Window.partitionBy(*grain).orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    since = Window.partitionBy(*grain).orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, 0)
    read = mixed.select(*grain, "__span", "__first", *[
        side(c).over(w).alias(f"{n}_{name}") for name, w in (("upto", upto), ("since", since))
        for n, side, c in (("sum", F.sum, "__value"), ("known", F.count, "__value"), ("n", F.count, "__row"))])
    edges = read.where(F.col("__span").isNotNull()).select(*keys, "__span", *series, *[
        F.when(F.col("__first"), F.col(f"{n}_since")).otherwise(F.col(f"{n}_upto")).alias(f"__{n}") for n in ("sum", "known", "n")])
    return met.where(inside).select(*keys, *parts).unionByName(edges)


def before_after(df: DataFrame, changes: DataFrame, before="60 s", after="60 s", value: str = "value",
                 keys: Sequence[str] = (), change_id: Sequence[str] = ("change_ts",),
                 by: Sequence[str] = (), change_ts: str = "change_ts", panes: int = 16) -> DataFrame:
    """Mean of a metric in ``[change - before, change)`` and ``[change, change + after]``, with difference and percent.

    ``keys`` and ``change_id`` are columns of the changes, ``by`` of the observations. Work grows with rows plus
    changes: a change is looked up once per pane, ``panes`` to the shorter span (as many times more to the longer
    one, up to ``panes`` times; beyond that each span has panes of its own). A series in a pane meets in one task,
    so dense series want more panes. Rows without time, changes without time and null keys match nothing.
    """
    keys = list(keys)
    ids = [c for c in dict.fromkeys(change_id) if c not in keys]
    series = [c for c in dict.fromkeys(by) if c not in keys and c not in ids]
    b, a, when = micros(before), micros(after) + 1, F.unix_micros(change_ts)
    lengths = {prior: n for prior, n in ((True, b), (False, a)) if n > 0}
    joint = len(lengths) < 2 or max(lengths.values()) <= panes * min(lengths.values())
    parts = None
    for sides in [list(lengths)] if joint else [[side] for side in lengths]:
        edges = F.array(*[F.struct(F.lit(prior).alias("prior"), (when - b if prior else when).alias("lo"),
                                   (when if prior else when + a).alias("hi")) for prior in sides])
        spans = (changes.where(F.col(change_ts).isNotNull()).withColumn("__side", F.explode(edges))
                 .select(*keys, F.col("__side.lo").alias("__lo"), F.col("__side.hi").alias("__hi"),
                         F.struct(F.col("__side.prior").alias("prior"), *[F.col(c).alias(f"id{i}") for i, c in enumerate(ids)]).alias("__span")))
        pane = max(1, min(lengths[side] for side in sides) // panes)
        got = _span_sums(df, spans, keys, series, value, pane)
        parts = got if parts is None else parts.unionByName(got)
    prior, mean = F.col("__span.prior"), df.select(F.avg(value)).schema[0].dataType

    def side(which, column):
        return F.sum(F.when(which, F.col(column)))

    def average(which):
        return (side(which, "__sum") / F.nullif(side(which, "__known"), F.lit(0))).cast(mean)

    names = [F.col(f"__span.id{i}").alias(c) for i, c in enumerate(ids)]
    grouped = parts.groupBy(*keys, *names, *series).agg(
        average(prior).alias("before"), average(~prior).alias("after"),
        F.coalesce(side(prior, "__n"), F.lit(0)).alias("n_before"), F.coalesce(side(~prior, "__n"), F.lit(0)).alias("n_after"))
    delta = F.col("after") - F.col("before")
    return grouped.where(F.col("n_before") + F.col("n_after") > 0).withColumns({
        "delta": delta, "percent": delta / F.nullif(F.col("before"), F.lit(0.0)) * F.lit(100.0)})


def multipath_head(device) -> object:
    """The visible head of a hidden multipath component device, else null."""
    device = F.col(device) if isinstance(device, str) else device
    pattern = r"^nvme(\d+)c\d+n(\d+)$"
    return F.when(device.rlike(pattern), F.concat(
        F.lit("nvme"), F.regexp_extract(device, pattern, 1), F.lit("n"), F.regexp_extract(device, pattern, 2)))


def alias_fold(df: DataFrame, heads: DataFrame, device: str = "device", value: str = "value",
               by: Sequence[str] = ()) -> DataFrame:
    """Book component devices under their head if that head exists, then sum again."""
    partial = df.groupBy(*by, device).agg(F.sum(value).alias(value)).withColumn("__head", multipath_head(device))
    known = heads.select(F.col(device).alias("__head")).distinct().withColumn("__known", F.lit(True))
    folded = partial.join(known, "__head", "left").withColumn(
        device, F.when(F.col("__known"), F.col("__head")).otherwise(F.col(device)))
    return folded.groupBy(*by, device).agg(F.sum(value).alias(value))


def sources_side_by_side(df: DataFrame, width="10 s", label: str = "source", sources: Sequence[str] = ("procfs", "ebpf"),
                         default: str = "procfs", value: str = "p99", labels: str = "tags") -> DataFrame:
    """Two sources of one metric in one row per time bucket; null where a source is silent.

    A conditional aggregate replaces the full outer join: one shuffle of
    pre-aggregated rows.
    """
    source = F.coalesce(F.try_element_at(labels, F.lit(label)), F.lit(default))
    rest = encode_labels(F.map_filter(labels, lambda k, v: k != F.lit(label)))
    us, w = F.unix_micros("ts"), micros(width)
    a, b = sources
    out = (df.where(source.isin(a, b))
           .groupBy("name", rest.alias("labels_key"), F.timestamp_micros(us - F.pmod(us, F.lit(w))).alias("bucket"))
           .agg(F.max(F.when(source == a, F.col(value))).alias(a), F.max(F.when(source == b, F.col(value))).alias(b)))
    return out.withColumn("ratio", F.col(b).cast("double") / F.nullif(F.col(a).cast("double"), F.lit(0.0)))
