"""Personal profiles: state, vocabulary, threshold, calibration samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limbwise.functions.draws import digest
from limbwise.functions.scans import Scan, hash_slice, running
from limbwise.operators.metadata import class_array
from limbwise.operators.scoring import clip_gate, filter_vocabulary
from limbwise.settings import Settings

# Vocabulary presets; "all" keeps every class.
PRESETS = {
    "all": [],
    "greetings": ["HELLO", "GOOD_MORNING", "THANK_YOU", "GOOD"],
    "people": ["ME", "YOU_PLURAL", "BOY", "GIRL", "BROTHER", "FATHER", "TEACHER", "PRIEST"],
    "objects": ["CAR", "CELL_PHONE", "HAT", "HOUSE", "PEN", "SHOE", "T-SHIRT", "TRAIN_TICKET", "WINDOW", "FAN"],
}


def clamp_threshold(value: Column, settings: Settings = Settings()) -> Column:
    """Within ``threshold_delta`` of the default and inside [0.01, 0.999]."""
    low = max(0.01, settings.confidence_threshold - settings.threshold_delta)
    high = min(0.999, settings.confidence_threshold + settings.threshold_delta)
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def current_profiles(changes: DataFrame, order: list[str], settings: Settings = Settings()) -> DataFrame:
    """State of every live profile from its change rows.

    The last create opens a profile and the last delete after it closes it. Later updates set
    the fields they carry; updates without an open profile change nothing. Both passes are
    partial aggregates, so a profile with very many changes stays cheap.
    """
    at = F.struct(*order)
    border = changes.where(F.col("action").isin("create", "delete")).groupBy("name").agg(
        F.max(F.struct(at.alias("at"), "action")).alias("_b"))
    opened = border.where(F.col("_b.action") == "create").select("name", F.col("_b.at").alias("_from"))
    live = changes.join(opened, "name").where(at >= F.col("_from"))
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"]
    state = live.groupBy("name").agg(
        newest("base_model").alias("base_model"), newest("vocabulary").alias("vocabulary"),
        newest("threshold").alias("threshold_requested"), F.min(at)[order[0]].alias("created_at"),
        F.max(at)[order[0]].alias("updated_at"))
    return (state.withColumn("base_model", F.coalesce("base_model", F.lit(settings.default_model)))
            .withColumn("vocabulary", F.coalesce("vocabulary", F.array().cast("array<string>")))
            .withColumn("threshold", clamp_threshold(F.coalesce("threshold_requested", F.lit(settings.confidence_threshold)), settings)))


def preset_vocabulary(preset: Column, given: Column, presets: dict[str, list[str]] | None = None) -> Column:
    """The preset's list when one is named (null for an unknown preset), else the given list."""
    known = F.lit(None).cast("array<string>")
    for name, labels in (presets or PRESETS).items():
        known = F.when(preset == name, F.array(*map(F.lit, labels)).cast("array<string>")).otherwise(known)
    return F.when(F.length(F.coalesce(preset, F.lit(""))) > 0, known).otherwise(given)


def resolve_vocabulary(requests: DataFrame, vocabulary: DataFrame, key: str = "name") -> DataFrame:
    """Replace requested labels by their official spelling; ``unknown`` lists the rest.

    A request with unknown labels is rejected as a whole (``vocabulary`` null). Lists are part
    of one request row, so regrouping them gathers no more than the row held.
    """
    names = vocabulary.select(F.upper("label").alias("_k"), F.col("label").alias("_official"))
    items = requests.select(key, F.posexplode("vocabulary").alias("_i", "_raw")).withColumn("_k", F.upper(F.trim("_raw")))
    matched = items.join(names, "_k", "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_raw", "_official"))).alias("_m"))
    unknown = F.transform(F.filter("_m", lambda s: s["_official"].isNull()), lambda s: s["_raw"])
    none = F.array().cast("array<string>")
    return (requests.drop("vocabulary").join(matched, key, "left")
            .withColumn("unknown", F.coalesce(unknown, none))
            .withColumn("vocabulary", F.when(F.size("unknown") == 0, F.coalesce(
                F.transform("_m", lambda s: s["_official"]), none)))
            .drop("_m"))


def effective_vocabulary(profiles: DataFrame, index: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``classes``: the profile's subset in global order, or every class when it has none.

    The class list is one value, read once.
    """
    every = class_array(index).scalar()
    upper = F.transform("vocabulary", lambda c: F.upper(c))
    with_all = profiles.withColumn("_all", every).withColumn("_up", upper)
    return with_all.withColumn("classes", F.when(F.size("vocabulary") == 0, F.col("_all")).otherwise(
        F.filter("_all", lambda c: F.array_contains("_up", F.upper(c))))).drop("_all", "_up")


def check_samples(samples: DataFrame, profiles: DataFrame, index: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Calibration samples with ``label`` in official spelling and a ``reason`` if refused.

    Labels are kept by name, so a later change of the vocabulary cannot shift them.
    """
    names = index.select(F.upper("label").alias("_k"), F.col("label").alias("_official")).distinct()
    known = effective_vocabulary(profiles, index, settings).select("name", F.col("classes").alias("_classes"))
    joined = (samples.withColumn("_k", F.upper(F.trim("label"))).join(names, "_k", "left").join(known, "name", "left"))
    reason = (F.when(F.col("_classes").isNull(), "unknown profile").when(F.col("_official").isNull(), "unknown label")
              .when(~F.array_contains("_classes", F.col("_official")), "outside profile vocabulary"))
    return (joined.withColumn("reason", reason).withColumn("label", F.coalesce("_official", "label"))
            .drop("_k", "_official", "_classes"))


def check_uploads(uploads: DataFrame, profiles: DataFrame, index: DataFrame, settings: Settings = Settings(),
                  stored: DataFrame | None = None) -> DataFrame:
    """Uploads ``upload, name, features, labels`` (clips of frames, a label each) with official ``labels`` and a ``reason`` if refused.

    An upload is taken or refused as a whole: ``features_shape`` when a frame has not ``input_width`` values or a clip has no
    frames, ``label_count`` unless there is one label per clip, ``unknown_profile``, ``unknown_label``, ``outside_vocabulary``, and
    ``stored_layout`` when the profile's ``stored`` samples (``name, features`` of one clip) have frames of another width. The first that applies, in this
    order, is given. An upload without clips is well formed.
    """
    clips, said = F.coalesce("features", F.array()), F.coalesce("labels", F.array())
    framed = F.forall(clips, lambda clip: F.coalesce((F.size(clip) > 0) & F.forall(clip, lambda f: F.coalesce(F.size(f) == settings.input_width, F.lit(False))), F.lit(False)))
    # the class list is one value; which spelling is official is looked up in it, so labels need no join
    known = effective_vocabulary(profiles, index, settings).select("name", F.col("classes").alias("_classes"))
    # the shape is judged below the join, which then carries the features only where a caller asks for them
    shaped = uploads.withColumn("_framed", framed).withColumn("_clips", F.size(clips))
    joined = shaped.join(known, "name", "left").withColumn("_every", class_array(index).scalar())
    spelled = F.transform(said, lambda x: F.get(F.filter("_every", lambda c: F.upper(c) == F.upper(F.trim(x))), F.lit(0)))
    joined = joined.withColumn("_labels", spelled)
    other = F.lit(False)
    if stored is not None:
        widths = stored.groupBy("name").agg(F.count_if(F.size(F.col("features")[0]) != settings.input_width).alias("_other"))
        joined, other = joined.join(widths, "name", "left"), F.coalesce(F.col("_other") > 0, F.lit(False))
    reason = (F.when(~F.col("_framed"), "features_shape").when(F.col("_clips") != F.size(said), "label_count").when(F.col("_classes").isNull(), "unknown_profile")
              .when(F.exists("_labels", lambda x: x.isNull()), "unknown_label")
              .when(F.exists("_labels", lambda x: ~F.array_contains("_classes", x)), "outside_vocabulary").when(other, "stored_layout"))
    kept = [F.when(reason.isNull(), F.col("_labels")).otherwise(F.col("labels")).alias("labels") if c == "labels" else F.col(c) for c in uploads.columns]
    return joined.select(*kept, reason.alias("reason"))


def uploaded_samples(checked: DataFrame) -> DataFrame:
    """The clips of the uploads that were taken: ``name, upload, place, label, features``."""
    return (checked.where("reason IS NULL").select("name", "upload", F.posexplode(F.arrays_zip("features", "labels")).alias("place", "_s"))
            .select("name", "upload", "place", F.col("_s.labels").alias("label"), F.col("_s.features").alias("features")))


def uploaded_labels(checked: DataFrame) -> DataFrame:
    """``uploaded_samples`` without the features: enough to count them. An upload that was taken has a label per clip."""
    return checked.where("reason IS NULL").select("name", "upload", F.posexplode("labels").alias("place", "label"))


def with_totals(profiles: DataFrame, samples: DataFrame) -> DataFrame:
    """Profiles with ``calibration_samples`` and ``per_class_samples``, over all samples that were ever taken."""
    counts = sample_counts(samples).groupBy("name").agg(
        F.sum("samples").alias("calibration_samples"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "samples")))).alias("per_class_samples"))
    none = F.create_map().cast("map<string,bigint>")
    return profiles.join(counts, "name", "left").withColumn("calibration_samples", F.coalesce("calibration_samples", F.lit(0))).withColumn(
        "per_class_samples", F.coalesce("per_class_samples", none))


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name", "label").agg(F.count("*").alias("samples"))


def eligibility(profiles: DataFrame, counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Whether a profile may be tuned: ``few_samples`` below the least number, ``one_class`` below two classes, else ``ok``."""
    sums = counts.groupBy("name").agg(F.sum("samples").alias("samples"), F.count("*").alias("classes"))
    out = profiles.select("name").join(sums, "name", "left").select(
        "name", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("classes", F.lit(0)).alias("classes"))
    reason = F.when(F.col("samples") < settings.calibration_min_samples, "few_samples").when(F.col("classes") < 2, "one_class").otherwise("ok")
    return out.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "ok")


def hold_out(samples: DataFrame, sample_id: str, settings: Settings = Settings()) -> DataFrame:
    """Add ``part``: the last half-even n * fraction samples in md5 order are held out.

    None are held out when fewer than two would remain. The rank is a sliced running count.
    """
    hashed = (samples.withColumn("_h", digest(settings.seed, F.col("name"), F.col(sample_id)))
              .withColumn("_slice", hash_slice(F.col("_h"))))
    ranked = running(hashed, ["name"], "_slice", [F.col("_h"), F.col(sample_id)], {"_rank": Scan("sum", F.lit(1))})
    sizes = samples.groupBy("name").agg(F.count("*").alias("_n"))
    held = F.rint(F.col("_n") * F.lit(settings.calibration_val_fraction)).cast("bigint")
    held = F.when(F.col("_n") - held < 2, 0).otherwise(held)
    return (ranked.join(sizes, "name").withColumn("part", F.when(F.col("_rank") > F.col("_n") - held, "heldout").otherwise("train"))
            .select(*samples.columns, "part"))


def apply_profiles(scored: DataFrame, profiles: DataFrame, classes: Column, settings: Settings = Settings()) -> DataFrame:
    """Score rows of a profile with its vocabulary and threshold; others keep the defaults."""
    own = profiles.select(F.col("name").alias("profile"), F.col("vocabulary").alias("_v"), F.col("threshold").alias("_t"))
    joined = scored.join(own, "profile", "left")
    filtered = joined.withColumn("probs", filter_vocabulary(F.col("probs"), classes, F.col("_v"))).withColumn(
        "threshold", clamp_threshold(F.coalesce("_t", F.lit(settings.confidence_threshold)), settings))
    return clip_gate(filtered, classes, F.col("threshold")).drop("_v", "_t")
