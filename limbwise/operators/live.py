"""Batch twins of the live path: throttle, ring buffer, hand loss, expiry, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limbwise.functions.columns import keyed_join, ratio
from limbwise.functions.scans import Scan, greedy_picks, positions, running, time_slice, trailing
from limbwise.settings import Settings


def _sliced(df: DataFrame, time: str, settings: Settings) -> DataFrame:
    return df.withColumn("_slice", time_slice(F.col(time), settings.session_slice_seconds))


def throttle(frames: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",),
             time: str = "ts", tie: str = "seq") -> DataFrame:
    """Drop a frame that comes under ``frame_gap_ms`` after the last accepted one."""
    placed = positions(_sliced(frames, time, settings), keys, "_slice", [F.col(time), F.col(tie)], "_at")
    timed = placed.withColumn("_m", F.unix_micros(time))
    picks = greedy_picks(timed, keys, "_slice", "_m", "_at", settings.frame_gap_ms * 1000)
    return picks.where("picked").select(*frames.columns)


def hand_loss(frames: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",),
              time: str = "ts", tie: str = "seq", hands: str = "has_hands") -> DataFrame:
    """Add ``empty_streak``, ``cleared`` (streak reached the limit: the buffer is wiped) and
    ``epoch`` (wipes before the row)."""
    keys = list(keys)
    order = [F.col("position")]
    placed = positions(_sliced(frames, time, settings), keys, "_slice", [F.col(time), F.col(tie)], "position")
    seen = running(placed, keys, "_slice", order, {"_hand": Scan("max", F.when(F.col(hands), F.col("position")))})
    streak = F.col("position") - F.coalesce("_hand", F.lit(0))
    flagged = (seen.withColumn("empty_streak", F.when(F.col(hands), 0).otherwise(streak).cast("bigint"))
               .withColumn("cleared", F.col("empty_streak") >= settings.hand_loss_frames).drop("_hand"))
    return running(flagged, keys, "_slice", order, {
        "epoch": Scan("sum", F.col("cleared").cast("bigint"), inclusive=False)}).drop("_slice")


def ring_buffer(frames: DataFrame, value: Column, settings: Settings = Settings(),
                keys: tuple[str, ...] = ("session_id", "epoch"), time: str = "ts", tie: str = "seq",
                stride: int = 1) -> DataFrame:
    """Newest ``sequence_length`` values per frame; ``ready`` when full and on the stride.

    A frame that clears the buffer is never ready (``cleared``, from ``hand_loss``).
    """
    n = settings.sequence_length
    out = trailing(_sliced(frames, time, settings), keys, "_slice", [F.col(time), F.col(tie)], value, n,
                   "buffer", position_out="pushes").drop("_slice")
    ready = (F.size("buffer") == n) & (F.col("pushes") % stride == 0)
    return out.withColumn("ready", ready & ~F.col("cleared") if "cleared" in frames.columns else ready)


def change_log(decisions: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",),
               time: str = "now", tie: str = "seq", sign: str = "candidate") -> DataFrame:
    """Rows whose (sign, status) differs from the last row that is not IDLE."""
    shown = _sliced(decisions.where(F.col("status") != settings.idle), time, settings)
    last = running(shown, keys, "_slice", [F.col(time), F.col(tie)], {
        "_last": Scan("max", F.struct(F.col(time), F.col(tie), F.col(sign).alias("sign"), "status"), inclusive=False)})
    same = F.coalesce((F.col("_last.sign") == F.col(sign)) & (F.col("_last.status") == F.col("status")), F.lit(False))
    return last.where(~same).drop("_last", "_slice")


def sessions(events: DataFrame, settings: Settings = Settings(), key: str = "session_id", time: str = "ts",
             tie: str = "seq") -> DataFrame:
    """Sessions that end after ``session_idle_seconds`` without an event: start, end, count.

    The idle time ends a session only when it is exceeded.
    """
    idle = settings.session_idle_seconds * 1_000_000
    timed = _sliced(events, time, settings).withColumn("_m", F.unix_micros(time))
    order = [F.col("_m"), F.col(tie)]
    before = running(timed, [key], "_slice", order, {"_b": Scan("max", F.col("_m"), inclusive=False)})
    opens = F.coalesce(F.col("_m") - F.col("_b") > idle, F.lit(True))
    named = running(before, [key], "_slice", order, {"_start": Scan("max", F.when(opens, F.col("_m")))})
    return named.groupBy(key, "_start").agg(F.count("*").alias("events"), F.max("_m").alias("_end")).select(
        key, F.timestamp_micros("_start").alias("started"), F.timestamp_micros("_end").alias("ended"), "events")


def request_rates(access: DataFrame, settings: Settings = Settings(), client: str = "client", time: str = "ts") -> DataFrame:
    """Requests of the client in the trailing window, counting all, and ``over_limit``; ``requests`` includes the row and those of its microsecond.

    A request at m counts C(m) - C(m - width) with C the running number of the client's requests. Requests are
    first reduced to counts per client and microsecond; these and their look-ups at m - width are scanned together in slices of one second,
    so a busy client is spread over tasks. Rows without a time have neither figure.
    """
    width = settings.rate_window_seconds * 1_000_000
    ticks = access.where(F.col(time).isNotNull()).groupBy(client, F.unix_micros(time).alias("_m")).agg(F.count("*").alias("_n"))
    row = lambda at, kind, n: [client, "_m", at.alias("_t"), F.lit(kind).alias("_kind"), n.alias("_n")]
    asked = ticks.select(*row(F.col("_m") - width, 1, F.lit(0).cast("bigint")))
    points = ticks.select(*row(F.col("_m"), 0, F.col("_n"))).unionByName(asked).withColumn("_second", F.floor(F.col("_t") / 1_000_000).cast("bigint"))
    summed = running(points, [client], "_second", [F.col("_t"), F.col("_kind")], {"_upto": Scan("sum", F.col("_n"))})
    counted = summed.groupBy(client, "_m").agg(F.sum(F.when(F.col("_kind") == 0, F.col("_upto")).otherwise(-F.col("_upto"))).alias("requests"))
    return keyed_join(access.withColumn("_m", F.unix_micros(time)), counted, [client, "_m"], "left").select(
        *access.columns, "requests", (F.col("requests") > settings.rate_limit).alias("over_limit"))


def lives(rows: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",),
          time: str = "ts", tie: str = "seq") -> DataFrame:
    """Add ``life``: how often the session was silent for more than ``session_idle_seconds`` before the row.

    As one more key it makes the batch operators start afresh where the stream does.
    """
    keys, order = list(keys), [F.col(time), F.col(tie)]
    before = running(_sliced(rows, time, settings), keys, "_slice", order, {"_b": Scan("max", F.unix_micros(time), inclusive=False)})
    ended = F.coalesce(F.unix_micros(time) - F.col("_b") > settings.session_idle_seconds * 1_000_000, F.lit(False))
    return running(before, keys, "_slice", order, {"life": Scan("sum", ended.cast("bigint"))}).drop("_b", "_slice")


def smoothed_rate(frames: DataFrame, value: Column, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",),
                  time: str = "ts", tie: str = "seq", out: str = "fps_ema") -> DataFrame:
    """Exponential average 0.9 * old + 0.1 * new, starting at the first value; exact over the whole history.

    Rows fall into blocks of 256 by position. Within a block the average is a running sum of values
    weighted by 0.9**-k; a block ends in 0.9**256 times the average before it plus its own part, so
    averages before blocks are sums over earlier blocks. Those more than 27 back weigh less than the
    smallest double and are all that is left out.
    """
    keys, size, reach = list(keys), 256, 28
    placed = positions(_sliced(frames, time, settings), keys, "_slice", [F.col(time), F.col(tie)], "_at").drop("_slice")
    k = F.col("_at") % size
    part = F.when(F.col("_at") == 1, value).otherwise(0.1 * value) * F.pow(F.lit(0.9), -k)
    inner = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = (placed.withColumn("_block", F.floor(F.col("_at") / size).cast("bigint"))
              .withColumn("_own", F.sum(part).over(inner) * F.pow(F.lit(0.9), k)))
    ends = summed.groupBy(*keys, "_block").agg(F.max_by("_own", "_at").alias("_end"))
    ahead = ends.select(*keys, "_end", F.col("_block").alias("_from"), F.explode(F.sequence(F.col("_block") + 1, F.col("_block") + reach)).alias("_block"))
    carry = ahead.groupBy(*keys, "_block").agg(F.sum(F.col("_end") * F.pow(F.lit(0.9), size * (F.col("_block") - F.col("_from") - 1))).alias("_before"))
    joined = keyed_join(summed, carry, [*keys, "_block"], "left")
    ema = F.col("_own") + F.coalesce("_before", F.lit(0.0)) * F.pow(F.lit(0.9), k + 1)
    return joined.withColumn(out, ema).select(*frames.columns, out)


def monotone_time(frames: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",),
                  arrival: str = "arrival", tie: str = "seq", millis: str = "ts_ms") -> DataFrame:
    """Lift a late frame time to the last one + 1: ``m(n) = n + max(t(k) - k, k <= n)`` in arrival order."""
    placed = positions(_sliced(frames, arrival, settings), keys, "_slice", [F.col(arrival), F.col(tie)], "_at")
    return (running(placed, keys, "_slice", [F.col("_at")], {"_lift": Scan("max", F.col(millis) - F.col("_at"))})
            .withColumn("frame_ms", F.col("_lift") + F.col("_at")).drop("_slice", "_at", "_lift"))


def discrete_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """One row per key with the lowest value that at least the share ``q`` of the key's values do not exceed; exact.

    ``df`` has counts ``n`` per key and value. A value falls into a slice, 1024 of which make a power of two; the counts of the slices tell
    which hold a wanted rank, and only their values are sorted, a slice in a task.
    """
    size = F.log2(F.least(F.greatest(F.abs(value), F.lit(1e-300)), F.lit(1e300)))
    step = F.floor(size * 1024) + F.lit(1_100_000)
    sliced = df.where(F.col(value).isNotNull()).withColumn("_slice", F.when(F.col(value) == 0, 0).when(F.col(value) < 0, -step).otherwise(step).cast("bigint"))
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_in"))
              .withColumn("_before", F.coalesce(F.sum("_in").over(upto), F.lit(0))).withColumn("_total", F.sum("_in").over(whole)))
    rank = lambda q: F.greatest(F.ceil(F.col("_total") * F.lit(q)), F.lit(1))
    holds = F.lit(False)
    for q in wanted.values():
        holds = holds | ((F.col("_before") < rank(q)) & (rank(q) <= F.col("_before") + F.col("_in")))
    own = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = keyed_join(sliced, slices.where(holds), [*keys, "_slice"]).withColumn("_upto", F.col("_before") + F.sum("n").over(own))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= rank(q), F.col(value))).alias(name) for name, q in wanted.items()])


def stage_timings(rows: DataFrame, stages: list[str], time: str, width: str = "1 hour") -> DataFrame:
    """Mean and exact p95 (the lowest time that 95 % of the rows do not exceed) of each stage per time window."""
    long = rows.select(F.window(time, width)["start"].alias("window_start"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("stage"), F.col(c).alias("ms")) for c in stages])).alias("s")).select("window_start", "s.stage", "s.ms")
    keys = ["window_start", "stage"]
    means = long.groupBy(*keys).agg(F.count("*").alias("frames"), F.avg("ms").alias("mean_ms"))
    tails = discrete_percentiles(long.groupBy(*keys, "ms").agg(F.count("*").alias("n")), keys, "ms", {"p95_ms": 0.95})
    return keyed_join(means, tails, keys, "left")


def windowed_metrics(predictions: DataFrame, width: str = "1 day", slide: str | None = None, by: tuple[str, ...] = ("model",),
                     time: str = "timestamp", settings: Settings = Settings()) -> DataFrame:
    """Log metrics per event-time window; runs on a batch or, with a watermark, on a stream."""
    win = F.window(time, width, slide) if slide else F.window(time, width)
    latency = F.when(F.col("latency_ms") != 0, F.col("latency_ms"))
    out = predictions.groupBy(win.alias("w"), *by).agg(
        F.count("*").alias("predictions_total"), F.count_if(F.col("status") == settings.uncertain).alias("uncertain_total"),
        F.avg("confidence").alias("confidence_mean"), F.min("confidence").alias("confidence_min"),
        F.max("confidence").alias("confidence_max"), F.avg(latency).alias("latency_mean"), F.max(latency).alias("latency_max"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                      "predictions_total", "uncertain_total", (F.col("uncertain_total") / F.col("predictions_total")).alias("uncertain_rate"),
                      "confidence_mean", "confidence_min", "confidence_max", "latency_mean", "latency_max")


def log_counts_by_latency(predictions: DataFrame, feedback: DataFrame, width: str = "1 day", slide: str | None = None, by: tuple[str, ...] = ("model",),
                          settings: Settings = Settings()) -> DataFrame:
    """The counts that ``log_window_figures`` needs, per event-time window, ``by`` and latency, in one aggregate that also runs on streams.

    Both logs go through it as one union. Null and zero latencies share the row without a latency, as do verdicts.
    """
    keys = [F.col(c) for c in by]
    p = predictions.select(F.col("timestamp"), *keys, F.lit(True).alias("_p"), "status", "confidence", F.nullif("latency_ms", F.lit(0)).cast("double").alias("latency"))
    f = feedback.select(F.col("timestamp"), *keys, F.lit(False).alias("_p"), "human_action", "corrected_class")
    win = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    action = lambda name: F.count_if(F.col("human_action") == name)
    out = p.unionByName(f, allowMissingColumns=True).groupBy(win.alias("w"), *by, "latency").agg(
        F.count("*").alias("n"), F.count_if("_p").alias("predictions_total"), F.count_if(~F.col("_p")).alias("feedback_total"),
        F.count_if(F.col("_p") & (F.col("status") == settings.uncertain)).alias("uncertain_total"),
        action("ACCEPT").alias("accept_total"), action("CORRECT").alias("correct_total"), action("REJECT").alias("reject_total"),
        F.count_if(F.length("corrected_class") > 0).alias("corrections_total"), F.count("confidence").alias("confidences"),
        F.sum("confidence").alias("confidence_sum"), F.min("confidence").alias("confidence_min"), F.max("confidence").alias("confidence_max"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "latency", *out.columns[2 + len(by):])


def log_window_figures(counts: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """The figures of ``events.log_metrics`` per window from ``log_counts_by_latency``, or from what its stream has stored.

    p50 and p95 are exact: the lowest latency with that share of the latencies at or below it. Null and zero latencies are left out; a share
    without rows is 0, the agreement without verdicts null.
    """
    keys = ["window_start", "window_end", *by]
    totals = ["predictions_total", "feedback_total", "accept_total", "correct_total", "reject_total", "corrections_total", "uncertain_total"]
    timed = F.when(F.col("latency").isNotNull(), F.col("n"))
    out = counts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in totals], F.try_divide(F.sum("confidence_sum"), F.sum("confidences")).alias("confidence_mean"),
        F.min("confidence_min").alias("confidence_min"), F.max("confidence_max").alias("confidence_max"),
        F.try_divide(F.sum(F.col("latency") * timed), F.sum(timed)).alias("latency_mean"), F.max("latency").alias("latency_max"))
    tails = discrete_percentiles(counts.select(*keys, "latency", "n"), keys, "latency", {"latency_p50": 0.5, "latency_p95": 0.95})
    decided = F.col("accept_total") + F.col("correct_total") + F.col("reject_total")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return keyed_join(out, tails, keys, "left").select(
        *keys, "predictions_total", "feedback_total", "corrections_total", "accept_total", "correct_total", "reject_total", "uncertain_total",
        ratio(F.col("uncertain_total"), F.col("predictions_total")).alias("uncertain_rate"),
        *map(zero, ("confidence_mean", "confidence_min", "confidence_max", "latency_mean", "latency_p50", "latency_p95", "latency_max")),
        F.coalesce(F.try_divide(F.lit(1000.0), F.col("latency_mean")), F.lit(0.0)).alias("throughput_fps"),
        F.try_divide(F.col("accept_total").cast("double"), decided).alias("agreement_rate"))


def log_windows(predictions: DataFrame, feedback: DataFrame, width: str = "1 day", slide: str | None = None, by: tuple[str, ...] = ("model",),
                settings: Settings = Settings()) -> DataFrame:
    """The figures of ``events.log_metrics`` per event-time window of two stored logs."""
    return log_window_figures(log_counts_by_latency(predictions, feedback, width, slide, by, settings), by)


def control_epochs(rows: DataFrame, settings: Settings = Settings(), session: str = "session_id", time: str = "ts", tie: str = "seq",
                   kind: str = "kind") -> DataFrame:
    """The frames among ``rows`` with ``life`` and ``resets``: how often the session had been silent too long, and how many control rows
    came before the frame in this life. As further keys they make the batch operators start afresh where the stream does."""
    lived = _sliced(lives(rows, settings, (session,), time, tie), time, settings)
    control = F.coalesce(F.col(kind) != "frame", F.lit(True)).cast("bigint")
    counted = running(lived, [session, "life"], "_slice", [F.col(time), F.col(tie)], {"resets": Scan("sum", control)})
    return counted.where(F.col(kind) == "frame").drop("_slice")
