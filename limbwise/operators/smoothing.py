"""Label smoothing per session: vote, streak, stability, emission, caption.

Sessions are ordered by time and scanned in time slices, so one long session is shared
by many tasks and no session is ever gathered.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limbwise.functions.columns import keyed_join, let, total
from limbwise.functions.scans import Scan, greedy_picks, running, time_slice, trailing
from limbwise.settings import Settings
from limbwise.sources.workspace import cut


def for_window(window: int | None, settings: Settings = Settings()) -> Settings:
    """Live settings: stable after one decision; an override of 1, 3, 5 or 7 votes by majority."""
    if window is None:
        return replace(settings, stable_after=1)
    if window not in (1, 3, 5, 7):
        raise ValueError("window must be one of 1, 3, 5, 7")
    return replace(settings, vote_window=window, min_votes=window // 2 + 1, stable_after=1)


def vote(window: Column, settings: Settings = Settings()) -> Column:
    """``STRUCT<label, votes, candidate, confidence>`` of an ordered window of (label, confidence).

    The most frequent label wins, the one seen first on ties. The confidence is the mean of
    the winner's even when it misses the majority and the candidate is UNCERTAIN.
    """
    need = max(1, min(settings.min_votes, max(1, settings.vote_window)))

    def count(labels: Column) -> Column:
        tally = F.transform(F.array_distinct(labels), lambda l, i: F.struct(
            F.size(F.filter(labels, lambda x: x == l)).alias("votes"), (-i).alias("early"), l.alias("label")))
        return F.array_max(tally)
    top = let(F.transform(window, lambda s: s["label"]), count)
    return let(top, lambda t: let(F.filter(window, lambda s: s["label"] == t["label"]), lambda own: F.struct(
        t["label"].alias("label"), t["votes"].alias("votes"),
        F.when(t["votes"] >= need, t["label"]).otherwise(settings.uncertain).alias("candidate"),
        (total(F.transform(own, lambda s: s["confidence"])) / F.size(own)).alias("confidence"))))


def with_epochs(stream: DataFrame, settings: Settings, reset: str, session: str = "session_id",
                time: str = "now", tie: str = "seq") -> DataFrame:
    """Add ``epoch``: the number of resets up to the row. A reset clears window, streak and emission."""
    sliced = stream.withColumn("_slice", time_slice(F.col(time), settings.session_slice_seconds))
    return running(sliced, [session], "_slice", [F.col(time), F.col(tie)],
                   {"epoch": Scan("sum", F.col(reset).cast("bigint"))}).drop("_slice")


def majority_votes(stream: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",),
                   time: str = "now", tie: str = "seq", label: str = "label", confidence: str = "confidence") -> DataFrame:
    """Add ``position``, ``window``, ``candidate``, ``smoothed``, ``votes`` and ``changed``.

    ``changed`` marks a candidate that differs from the one before it.
    """
    s, keys = settings, list(keys)
    sliced = stream.withColumn("_slice", time_slice(F.col(time), s.session_slice_seconds))
    seen = trailing(sliced, keys, "_slice", [F.col(time), F.col(tie)],
                    F.struct(F.col(label).alias("label"), F.col(confidence).alias("confidence")),
                    max(1, s.vote_window), "_window", carry_out="_carry", position_out="position")
    voted = seen.withColumn("_v", vote(F.col("_window"), s)).withColumn("window", F.size("_window"))
    flat = voted.select(*stream.columns, "_slice", "position", "window", F.col("_v.candidate").alias("candidate"),
                        F.col("_v.confidence").alias("smoothed"), F.col("_v.votes").alias("votes"), "_carry")
    # the first row of a slice follows the decision on the carried window
    entry = F.when(F.size("_carry") > 0, vote(F.col("_carry"), s)["candidate"])
    before = F.coalesce(F.lag("candidate").over(Window.partitionBy(*keys, "_slice").orderBy("position")), entry)
    return flat.withColumn("changed", ~before.eqNullSafe(F.col("candidate"))).drop("_carry")


def with_streaks(voted: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Add ``streak`` (run length of the candidate) and ``stable``."""
    s = settings
    since = running(voted, list(keys), "_slice", [F.col("position")],
                    {"_since": Scan("max", F.when(F.col("changed"), F.col("position")))})
    return (since.withColumn("streak", F.col("position") - F.col("_since") + 1)
            .withColumn("stable", ~F.col("candidate").isin(s.uncertain, s.idle) & (F.col("streak") >= max(1, s.stable_after)))
            .drop("_since"))


def with_emissions(stable: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",),
                   time: str = "now") -> DataFrame:
    """Add ``should_emit``: stable, and a new label or the cooldown since the last emission is over.

    After any stable row the last emitted label is that row's label (it was emitted there or
    already was the last), so a change of label among stable rows is all the state needed,
    and the cooldown walk restarts at every change.
    """
    s, keys = settings, list(keys)
    if not s.suppress_duplicates:
        return stable.withColumn("should_emit", F.col("stable"))
    gap = round(s.cooldown_seconds * 1_000_000)
    only = stable.where("stable").select(*keys, "_slice", "position", "candidate", F.unix_micros(time).alias("_m"))
    previous = running(only, keys, "_slice", [F.col("position")], {
        "_last": Scan("max", F.struct("position", "candidate", "_m"), inclusive=False)})
    anew = (~F.col("_last.candidate").eqNullSafe(F.col("candidate"))) | (F.col("_m") - F.col("_last._m") >= gap)
    flagged = previous.withColumn("_anew", anew).drop("_last")
    picks = greedy_picks(flagged, keys, "_slice", "_m", "position", gap, F.col("_anew"))
    hits = picks.where("picked").select(*keys, "position", F.lit(True).alias("should_emit"))
    return keyed_join(stable, hits, [*keys, "position"], "left").withColumn(
        "should_emit", F.coalesce("should_emit", F.lit(False)))


def with_status(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    c = F.col("candidate")
    return df.withColumn("status", F.when(c.isin(settings.idle, settings.uncertain), c)
                         .when(F.col("stable"), "CONFIDENT").otherwise("PENDING"))


def smooth(stream: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("session_id",),
           time: str = "now", tie: str = "seq", label: str = "label", confidence: str = "confidence") -> DataFrame:
    """Smoothed decision per observation: vote, streak, stability, emission and status.

    ``keys`` identify a session (plus its epoch, if any). The votes feed several scans and
    are stored once.
    """
    voted = cut(majority_votes(stream, settings, keys, time, tie, label, confidence), "votes")
    emitted = with_emissions(with_streaks(voted, settings, keys), settings, keys, time)
    return with_status(emitted, settings).drop("_slice", "changed")


def caption_words(events: DataFrame, settings: Settings = Settings(), session: str = "session_id",
                  time: str = "now", tie: str = "seq") -> DataFrame:
    """Emitted labels that stay in the caption, with their place.

    ``events.word`` is an emitted label; a row with ``undo`` true removes the last word that is
    left, if any. A word stays when the stack never falls below its own height again.
    """
    order = [F.col(time), F.col(tie)]
    step = F.when(F.col("undo"), -1).when(F.col("word").isNotNull(), 1).otherwise(0).cast("bigint")
    acts = (events.withColumn("_step", step).where(F.col("_step") != 0)
            .withColumn("_slice", time_slice(F.col(time), settings.session_slice_seconds)))
    summed = running(acts, [session], "_slice", order, {"_sum": Scan("sum", F.col("_step"))})
    floor = cut(running(summed, [session], "_slice", order, {"_low": Scan("min", F.col("_sum"))}), "caption")
    # an undo on an empty caption removes nothing: lift the sum by its lowest value below 0
    height = floor.withColumn("_height", F.col("_sum") - F.least(F.lit(0), F.col("_low")))
    later = running(height, [session], "_slice", order,
                    {"_later": Scan("min", F.col("_height"), backward=True, inclusive=False)})
    left = later.where((F.col("_step") == 1) & (F.coalesce("_later", F.col("_height")) >= F.col("_height")))
    return left.select(session, F.col("_height").alias("place"), "word")


def caption_lines(words: DataFrame, session: str = "session_id", slice_words: int = 4096) -> DataFrame:
    """The caption of each session as one text: words are joined per slice of places in parallel, then only the texts of the slices meet."""
    joined = lambda at, text: F.when(F.count(text) > 0, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda s: s[text]), " ")).alias("text")
    sliced = words.withColumn("_slice", F.floor(F.col("place") / slice_words))
    texts = sliced.groupBy(session, "_slice").agg(joined("place", "word"))
    return texts.groupBy(session).agg(joined("_slice", "text")).withColumn("text", F.coalesce("text", F.lit("")))
