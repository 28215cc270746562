"""Evaluation against gold tables: boundaries, cues, keyframes, tracks, frame text and strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import prf, presence, rate, ratio
from tidemark.functions.text import edit_distance, normalise_text, word_edit_distance, words
from tidemark.operators.matching import match_in_time
from tidemark.operators.sequence import is_hot, number_rows
from tidemark.session import FOLD_ROWS_KEY, limit, materialise


def _counts(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _sided(correct: DataFrame, predicted: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: matched, predicted and gold counts; keys known to one side only count as zero."""
    joined = _counts(predicted, keys, "predicted").join(_counts(gold, keys, "gold"), list(keys), "full")
    joined = joined.join(_counts(correct, keys, "correct"), list(keys), "left")
    return joined.na.fill(0, ["correct", "predicted", "gold"])


def match_boundaries(
    pred: DataFrame, gold: DataFrame, tolerance_ms: int, order: Sequence[str] = ()
) -> DataFrame:
    """Gold boundaries in turn, each with the nearest free prediction within tolerance.

    Their turn is ``order``, columns of ``gold``, or else their time. ``gold.tolerance_ms`` (null: the
    default) may be smaller or larger than the default.
    """
    own = F.coalesce(F.col("tolerance_ms"), F.lit(tolerance_ms)) if "tolerance_ms" in gold.columns else F.lit(tolerance_ms)
    matched = match_in_time(pred, gold, ["source_id"], ["boundary_ms"], own, tolerance_ms, order)
    return matched.withColumnRenamed("error_boundary_ms", "error_ms")


def boundary_scores(matches: DataFrame, pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of boundaries per source."""
    counts = _sided(matches, pred, gold, ["source_id"])
    return counts.select("source_id", *prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def timing_stats(matches: DataFrame, error: str = "error_ms") -> DataFrame:
    """Mean, exact median, least and greatest error per source.

    Errors are first counted per value, so the exact median works on the distinct errors only.
    """
    counted = matches.groupBy("source_id", error).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    return counted.groupBy("source_id").agg(
        total.alias("matches"),
        (F.sum(F.col(error) * F.col("_n")) / total).alias("mean"),
        F.percentile(error, 0.5, F.col("_n")).alias("median"),
        F.min(error).alias("minimum"),
        F.max(error).alias("maximum"),
    )


def confusion(matches: DataFrame, pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Counts of (gold transition type, predicted boundary type) over the matches."""
    typed = matches.join(pred.select("source_id", "pred_id", "boundary_type"), ["source_id", "pred_id"])
    typed = typed.join(gold.select("source_id", "gold_id", "transition_type"), ["source_id", "gold_id"])
    return typed.groupBy("transition_type", "boundary_type").agg(F.count(F.lit(1)).alias("matches"))


def keyframe_coverage(shots: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Per source: shots with a keyframe inside, without any, and surplus keyframes."""
    keys = ["source_id", "shot_id"]
    near = keyframes.select(*keys, "timestamp_ms").join(shots.select(*keys, "start_ms", "end_ms"), keys)
    inside = (F.col("timestamp_ms") >= F.col("start_ms")) & (F.col("timestamp_ms") < F.col("end_ms"))
    found = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.max(F.when(inside, 1).otherwise(0)).alias("covered")
    )
    per_shot = shots.select(*keys).join(found, keys, "left").na.fill(0, ["frames", "covered"])
    totals = per_shot.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("shots"),
        F.sum("covered").cast("long").alias("covered"),
        F.count_if(F.col("frames") == 0).alias("missing"),
        F.sum(F.greatest(F.col("frames") - 1, F.lit(0))).cast("long").alias("surplus"),
    )
    return totals.withColumn("coverage_rate", rate(F.col("covered"), F.col("shots")))


def track_set_score(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Distinct (language, title, default, forced) sets compared; null matches null."""
    names = ["language", "title", "is_default", "is_forced"]
    keys = ["source_id", *names]
    sides = (
        pred.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("g"))
        .unionByName(gold.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("g")))
        .groupBy(*keys)
        .agg(F.max("p").alias("p"), F.max("g").alias("g"))
    )
    counts = sides.groupBy("source_id").agg(
        F.sum(F.col("p") * F.col("g")).cast("long").alias("correct"),
        F.sum("p").cast("long").alias("predicted"),
        F.sum("g").cast("long").alias("gold"),
    )
    return counts.select(
        "source_id", *prf(F.col("correct"), F.col("predicted"), F.col("gold")),
        F.coalesce(ratio(F.col("correct"), F.col("gold")), F.lit(1.0)).alias("discovery_accuracy"),
    )


def match_cues(pred: DataFrame, gold: DataFrame, tolerance_ms: int, order: Sequence[str] = ()) -> DataFrame:
    """Gold cues in turn (``order``, or else their time), each with the free cue of its language and
    least summed error."""
    keys = ["source_id", "language"]
    matched = match_in_time(
        pred.withColumn("language", F.coalesce("language", F.lit("\u0000"))),
        gold.withColumn("language", F.coalesce("language", F.lit("\u0000"))),
        keys, ["start_ms", "end_ms"], F.lit(tolerance_ms), tolerance_ms, order,
    )
    return matched.withColumn("language", F.nullif(F.col("language"), F.lit("\u0000")))


def cue_scores(matches: DataFrame, pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Cue precision, recall, F1, exact-text rate, character error rate and edge errors per source."""
    texts = matches.join(
        pred.select("source_id", "pred_id", F.col("text").alias("p_text")), ["source_id", "pred_id"]
    ).join(gold.select("source_id", "gold_id", F.col("text").alias("g_text")), ["source_id", "gold_id"])
    clean_p, clean_g = normalise_text(F.col("p_text")), normalise_text(F.col("g_text"))
    texts = texts.withColumns({"_p": clean_p, "_g": clean_g})
    quality = texts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("correct"),
        F.count_if(F.col("p_text") == F.col("g_text")).alias("exact"),
        F.sum(edit_distance(F.col("_p"), F.col("_g"))).alias("edits"),
        F.sum(F.length("_g")).alias("characters"),
        F.sum("error_start_ms").alias("start_error_ms"),
        F.sum("error_end_ms").alias("end_error_ms"),
    )
    sides = _counts(pred, ["source_id"], "predicted").join(
        _counts(gold, ["source_id"], "gold"), "source_id", "full"
    ).join(quality, "source_id", "left")
    sides = sides.na.fill(
        0, ["correct", "predicted", "gold", "exact", "edits", "characters", "start_error_ms", "end_error_ms"]
    )
    return sides.select(
        "source_id", *prf(F.col("correct"), F.col("predicted"), F.col("gold")),
        ratio(F.col("exact"), F.col("correct")).alias("exact_rate"),
        rate(F.col("edits"), F.col("characters")).alias("character_error_rate"),
        "start_error_ms", "end_error_ms",
    )


def state_accuracy(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of expected adapter states that were observed, per source."""
    joined = expected.join(
        observed.select("source_id", "adapter", F.col("status").alias("_seen")), ["source_id", "adapter"], "left"
    )
    totals = joined.groupBy("source_id").agg(
        F.count_if(F.col("_seen").eqNullSafe(F.col("expected_status"))).alias("correct"),
        F.count(F.lit(1)).alias("expected"),
    )
    return totals.withColumn("accuracy", F.coalesce(ratio(F.col("correct"), F.col("expected")), F.lit(1.0)))


def frame_texts(regions: DataFrame) -> DataFrame:
    """Region texts of a frame joined in (time, id) order.

    Where some frame has more regions than one list may hold, regions are numbered and joined in parts
    of consecutive ones, and the parts are joined; a frame's text is one value, its regions never are.
    """
    frame = ["source_id", "keyframe_id"]

    def joined(order: Sequence[str], text: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
        return F.array_join(F.transform(ordered, lambda r: r["_text"]), " ")

    size = limit(regions.sparkSession, FOLD_ROWS_KEY)
    order = ["timestamp_ms", "observation_id"]
    # Stored, so that measuring does not compute the regions twice.
    regions = materialise(regions.select(*frame, *order, "normalized_text", "ocr_confidence"))
    if not is_hot(regions, frame, FOLD_ROWS_KEY):
        return regions.groupBy(*frame).agg(
            joined(order, "normalized_text").alias("predicted"), F.count(F.lit(1)).alias("regions"),
            F.avg("ocr_confidence").alias("mean_confidence"),
        )
    numbered = number_rows(regions, frame, order, "_no")
    parts = numbered.groupBy(*frame, F.floor((F.col("_no") - 1) / size).cast("long").alias("_part")).agg(
        joined(order, "normalized_text").alias("_said"), F.count("normalized_text").alias("_texts"),
        F.count(F.lit(1)).alias("regions"),
        F.sum("ocr_confidence").alias("_sum"), F.count("ocr_confidence").alias("_n"),
    )
    # A part without any text adds no space.
    said = F.when(F.col("_texts") > 0, F.col("_said"))
    return parts.withColumn("_said", said).groupBy(*frame).agg(
        joined(["_part"], "_said").alias("predicted"), F.sum("regions").alias("regions"),
        (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean_confidence"),
    )


def score_frames(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Edits of each gold frame; a frame without prediction is compared with empty text and no words.

    Sides may bring their own word arrays, ``predicted_words`` and ``transcription_words``; otherwise words are
    what whitespace parts.
    """
    keys = ["source_id", "keyframe_id"]

    def own_or(name: str, df: DataFrame, text: str) -> Column:
        return F.col(name) if name in df.columns else words(F.col(text))

    extra = [c for c in predicted.columns if c not in (*keys, "predicted", "predicted_words")]
    found = predicted.select(*keys, "predicted", *extra, own_or("predicted_words", predicted, "predicted").alias("_pw"))
    joined = gold.withColumn("_gw", own_or("transcription_words", gold, "transcription")).join(found, keys, "left")
    joined = joined.withColumns({
        "predicted": F.coalesce("predicted", F.lit("")), "_pw": F.coalesce("_pw", F.array().cast("array<string>")),
    })
    return joined.withColumns(
        {
            "exact": (F.col("predicted") == F.col("transcription")).cast("long"),
            "char_edits": edit_distance(F.col("predicted"), F.col("transcription")),
            "chars": F.length("transcription").cast("long"),
            "word_edits": word_edit_distance(F.col("_pw"), F.col("_gw")),
            "words": F.size("_gw").cast("long"),
        }
    ).drop("_pw", "_gw", "transcription_words")


def _text_rates() -> list[Column]:
    frames = F.count("keyframe_id")
    return [
        frames.alias("frames"),
        ratio(F.sum("exact"), frames).alias("exact_rate"),
        ratio(F.sum("char_edits"), F.sum("chars")).alias("character_error_rate"),
        ratio(F.sum("word_edits"), F.sum("words")).alias("word_error_rate"),
    ]


def frame_text_score(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact rate and micro-averaged character and word error rates."""
    return scored.groupBy(*by).agg(*_text_rates())


def _presence_of(df: DataFrame, text: str, name: str) -> DataFrame:
    """Whether frames show text: their own ``has_text``, or else that their text is not empty."""
    shown = F.col("has_text") if "has_text" in df.columns else F.col(text) != ""
    return df.select("source_id", "keyframe_id", F.coalesce(shown, F.lit(False)).alias(name))


def presence_score(predicted: DataFrame, gold: DataFrame, universe: str = "all") -> DataFrame:
    """Text present or absent per frame. ``'all'`` counts frames known to the prediction only as
    false positives, ``'gold'`` looks at gold frames alone.

    A side with the column ``has_text`` says itself which frames show text; a text found may be empty.
    """
    if universe not in ("all", "gold"):
        raise ValueError("universe must be 'all' or 'gold'")
    keys = ["source_id", "keyframe_id"]
    how = "full" if universe == "all" else "left"
    joined = _presence_of(gold, "transcription", "_expects").join(_presence_of(predicted, "predicted", "_has"), keys, how)
    expects, has = F.coalesce("_expects", F.lit(False)), F.coalesce("_has", F.lit(False))
    counts = joined.agg(
        F.count_if(expects & has).alias("tp"), F.count_if(~expects & has).alias("fp"),
        F.count_if(expects & ~has).alias("fn"),
    )
    return counts.select("tp", "fp", "fn", *presence(F.col("tp"), F.col("fp"), F.col("fn")))


def duplicate_rate(regions: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Share of rows that repeat another row exactly; copies are counted before the shuffle."""
    copies = regions.groupBy(*identity).agg(F.count(F.lit(1)).alias("_copies"))
    totals = copies.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("unique_rows"))
    return totals.select(
        "rows", "unique_rows", rate(F.col("rows") - F.col("unique_rows"), F.col("rows")).alias("duplicate_rate")
    )


def track_compression(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """Repeated-member rate of tracks and how far tracks compress the regions."""
    members = tracks.agg(
        F.count(F.lit(1)).alias("tracks"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("members"),
        F.coalesce(F.sum(F.greatest(F.col("members") - 1, F.lit(0))), F.lit(0)).alias("repeated"),
    )
    rows = regions.agg(F.count(F.lit(1)).alias("observations"))
    one = F.lit(1).alias("_one")
    # Two one-row aggregates side by side, joined on a constant.
    joined = members.withColumn("_one", one).join(rows.withColumn("_one", one), "_one").drop("_one")
    return joined.select(
        "tracks", "members", "repeated", "observations",
        rate(F.col("repeated"), F.col("members")).alias("repeated_rate"),
        rate(F.col("observations") - F.col("tracks"), F.col("observations")).alias("compression"),
    )


def prediction_only_frames(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Frames with predictions that the gold table does not know, and gold text without any."""
    keys = ["source_id", "keyframe_id"]
    joined = _presence_of(predicted, "predicted", "_has").join(_presence_of(gold, "transcription", "_expects"), keys, "full")
    return joined.agg(
        F.count_if(F.col("_expects").isNull()).alias("prediction_only"),
        F.count_if(F.coalesce("_expects", F.lit(False)) & ~F.coalesce("_has", F.lit(False))).alias("gold_text_without_prediction"),
    )


def integrity_counts(regions: DataFrame, gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """Regions whose time is negative or not that of the gold frame, and unresolved references.

    Times and references are looked up side by side, each with its own columns only, and both references of a
    region in one pass over the evidence. A reference is resolved where evidence has it, however often. Gold
    rows of one frame at different times agree with no region.
    """
    keys, refs = ["source_id", "keyframe_id"], ["evidence_ref", "source_frame_evidence_ref"]
    none = F.lit(0).cast("long")
    frames = gold.groupBy(*keys).agg(F.min("timestamp_ms").alias("_first_ms"), F.max("timestamp_ms").alias("_last_ms"))
    differs = (F.col("timestamp_ms") != F.col("_first_ms")) | (F.col("timestamp_ms") != F.col("_last_ms"))
    bad_time = F.col("timestamp_ms").isNull() | (F.col("timestamp_ms") < 0) | F.coalesce(differs, F.lit(False))
    timed = regions.select(*keys, "timestamp_ms").join(frames, keys, "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("regions"), F.count_if(bad_time).alias("invalid"), none.alias("unresolved")
    )
    asked = regions.select("source_id", F.inline(F.array(*[
        F.struct(F.col(ref).alias("_ref"), F.col(other).alias("_other"), F.lit(ref == refs[0]).alias("_own"))
        for ref, other in (refs, refs[::-1])
    ])))
    known = evidence.select("source_id", F.col("evidence_ref").alias("_ref"))
    # Copies of a pair of references share their fate; a pair that misses both is asked for twice.
    pair = [F.when(F.col("_own"), F.col(a)).otherwise(F.col(b)) for a, b in (("_ref", "_other"), ("_other", "_ref"))]
    lost = asked.join(known, ["source_id", "_ref"], "left_anti").groupBy(
        "source_id", pair[0].alias("_first"), pair[1].alias("_second")
    ).agg(F.greatest(F.count_if("_own"), F.count_if(~F.col("_own"))).alias("unresolved"))
    lost = lost.select("source_id", none.alias("regions"), none.alias("invalid"), "unresolved")
    return timed.unionByName(lost).groupBy("source_id").agg(
        F.sum("regions").alias("regions"), F.sum("invalid").alias("invalid_timestamps"),
        F.sum("unresolved").alias("unresolved_refs"),
    )


def size_bucket(max_height: Column) -> Column:
    return (
        F.when(max_height.isNull(), "no_text_or_unboxed")
        .when(max_height < 24, "small").when(max_height < 64, "medium").otherwise("large")
    )


def confidence_bucket(mean_confidence: Column) -> Column:
    return (
        F.when(mean_confidence.isNull(), "no_observation")
        .when(mean_confidence < 50, "low_0_49").when(mean_confidence < 80, "medium_50_79")
        .otherwise("high_80_100")
    )


# Strata that are reported even when empty.
FIXED_BUCKETS = {
    "text_size": ("small", "medium", "large", "no_text_or_unboxed"),
    "confidence": ("no_observation", "low_0_49", "medium_50_79", "high_80_100"),
}


def stratify(scored: DataFrame) -> DataFrame:
    """Frame text scores overall and per source, category, difficulty, text size and confidence.

    ``scored`` also carries ``categories`` and ``difficulty`` arrays, ``max_height`` and
    ``mean_confidence``. One pass: each frame is repeated per stratum and combined before the
    shuffle.
    """
    def tag(dim: str, value: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), value.alias("value"))

    strata = F.concat(
        F.array(
            tag("overall", F.lit("all")),
            tag("source", F.col("source_id")),
            tag("text_size", size_bucket(F.col("max_height"))),
            tag("confidence", confidence_bucket(F.col("mean_confidence"))),
        ),
        F.transform(F.array_distinct("categories"), lambda c: tag("category", c)),
        F.transform(F.array_distinct("difficulty"), lambda c: tag("difficulty", c)),
    )
    fixed = [(dim, value) for dim, values in FIXED_BUCKETS.items() for value in values]
    measured = scored.select(
        "keyframe_id", "exact", "char_edits", "chars", "word_edits", "words", F.inline(strata)
    )
    names = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(v).alias("value")) for d, v in fixed])
    empty = scored.sparkSession.range(1).select(F.inline(names))
    for column, kind in (
        ("keyframe_id", "string"), ("exact", "bigint"), ("char_edits", "bigint"), ("chars", "bigint"),
        ("word_edits", "bigint"), ("words", "bigint"),
    ):
        empty = empty.withColumn(column, F.lit(None).cast(kind))
    return measured.unionByName(empty).groupBy("dim", "value").agg(*_text_rates())
