"""Tokens from binned features, structured strings, vocabularies and id sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave import dims


def ordered(value: str, by: str) -> Column:
    """Aggregate: the values as an array in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col(value).alias("v")))), lambda x: x["v"])


def token(feature: Column, level: Column) -> Column:
    return F.concat_ws("_", feature, level)


def band_token(band: Column, level: Column, channel: Column) -> Column:
    """The other order: band and level in capitals, then the channel."""
    return F.concat_ws("_", F.upper(band), F.upper(level), channel)


def token_lists(binned: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """key, tokens: one token for each feature, in the order of `order`."""
    return binned.withColumn("token", token(F.col("feature"), F.col("level"))).groupBy(key).agg(ordered("token", order).alias("tokens"))


def feature_names(spark: SparkSession, channels: list[str], spectral: bool = False, connectivity: bool = False) -> DataFrame:
    """feature, f_idx: bands of each channel, then spectral features of each, then pairs of channels."""
    names = [f"{b}_{c}" for c in channels for b in dims.BANDS]
    names += [f"{s}_{c}" for c in channels for s in ("entropy", "peak_freq", "centroid")] if spectral else []
    names += [f"conn_{a}_{b}" for i, a in enumerate(channels) for b in channels[i + 1 :]] if connectivity else []
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, f_idx int")


def groups(spark: SparkSession) -> DataFrame:
    """g_idx, grp, c_idx, channel: the channel groups in order."""
    rows = [(i, g, j, c) for i, (g, members) in enumerate(dims.CHANNEL_GROUPS.items()) for j, c in enumerate(members)]
    return spark.createDataFrame(rows, "g_idx int, grp string, c_idx int, channel string")


def parsed(lists: DataFrame, key: str) -> DataFrame:
    """key, band, channel, level, pos: tokens of three parts and more; of equal band and channel the last one counts, at the place of the first."""
    rows = lists.select(key, F.posexplode("tokens").alias("pos", "token")).withColumn("part", F.split("token", "_")).filter(F.size("part") >= 3)
    rows = rows.select(key, "pos", *(F.get("part", F.lit(i)).alias(n) for i, n in enumerate(("band", "channel", "level"))))
    return rows.groupBy(key, "channel", "band").agg(F.max_by("level", "pos").alias("level"), F.min("pos").alias("pos"))


def dominant(parts: DataFrame, key: str) -> DataFrame:
    """key, channel, band: the first high band by priority, else the first medium one seen, else none."""
    high = F.col("level").isin("HIGH", "VERY_HIGH")
    priority = F.array_position(F.array(*map(F.lit, dims.BAND_PRIORITY)), F.col("band"))
    rank = F.when(high & (priority > 0), F.struct(F.lit(0).alias("tier"), priority.cast("long").alias("k"))).when(F.col("level") == "MEDIUM", F.struct(F.lit(1).alias("tier"), F.col("pos").cast("long").alias("k")))
    return parts.withColumn("rank", rank).filter("rank is not null").groupBy(key, "channel").agg(F.min_by("band", "rank").alias("band"))


def structured(lists: DataFrame, key: str) -> DataFrame:
    """key, structured: `[GROUP:band_channel ...]` of each group with a dominant band, in the order of the groups."""
    best = dominant(parsed(lists, key), key)
    members = best.join(F.broadcast(groups(lists.sparkSession)), "channel").withColumn("said", F.concat_ws("_", "band", "channel"))
    each = members.groupBy(key, "g_idx", "grp").agg(ordered("said", "c_idx").alias("said"))
    each = each.withColumn("said", F.concat(F.lit("["), F.upper("grp"), F.lit(":"), F.array_join("said", " "), F.lit("]")))
    whole = each.groupBy(key).agg(F.array_join(ordered("said", "g_idx"), " ").alias("structured"))
    return lists.select(key).join(whole, key, "left").withColumn("structured", F.coalesce("structured", F.lit("")))


def pattern(text: Column) -> Column:
    """Summary of a structured string: sides, then beta, then alpha."""
    has = lambda s: F.contains(text, F.lit(s))
    count = lambda s: F.size(F.split(text, s)) - 1
    sides = F.when(count("LEFT_MOTOR") > count("RIGHT_MOTOR"), "LEFT_DOMINANT").when(count("RIGHT_MOTOR") > count("LEFT_MOTOR"), "RIGHT_DOMINANT").otherwise("BILATERAL")
    beta, alpha = has("beta"), has("alpha")
    said = F.concat_ws("_", F.when(has("LEFT_MOTOR") & has("RIGHT_MOTOR") & (beta | alpha), sides), F.when(beta, "BETA_ACTIVE"), F.when(alpha, "ALPHA_PRESENT"))
    return F.when(said == "", "GENERAL").otherwise(said)


def contextual(text: Column, label: Column | None = None) -> Column:
    """Task token (if there are labels), the structured string, and its pattern."""
    names = {x.id: "TASK_" + x.token.strip("<>") for x in dims.MOTOR_LABELS}
    task = None
    if label is not None:
        task = F.lit("TASK_UNKNOWN")
        for i, name in names.items():
            task = F.when(label == i, name).otherwise(task)
        task = F.concat(F.lit("<"), task, F.lit(">"))
    return F.concat_ws(" ", *([task] if task is not None else []), text, F.concat(F.lit("<PATTERN:"), pattern(text), F.lit(">")))


def special_tokens() -> Column:
    """Map of name to token: the structural tokens by name, then the tasks' tokens by id (as text)."""
    pairs = {t.strip("<>"): t for t in dims.SPECIAL_TOKENS} | {str(x.id): x.token for x in dims.MOTOR_LABELS}
    return F.create_map(*(F.lit(v) for pair in pairs.items() for v in pair))


def full_vocabulary(names: DataFrame, n_bins: int = 3) -> DataFrame:
    """token: all features with all levels, and the structure tokens; distinct."""
    spark = names.sparkSession
    made = names.select(F.explode(F.transform(F.array(*map(F.lit, dims.levels(n_bins))), lambda v: F.concat_ws("_", F.col("feature"), v))).alias("token"))
    return made.union(spark.createDataFrame([(t,) for t in dims.STRUCTURE_TOKENS], "token string")).distinct()


def vocabulary(tokens: DataFrame, min_frequency: int = 1, max_size: int = 10_000) -> DataFrame:
    """token, id, freq: special tokens first, then tokens by frequency and name; `max_size` counts all.

    Counts are combined before the shuffle; only the `max_size` most frequent ones are ranked together.
    """
    room = max(0, max_size - len(dims.SPECIAL_TOKENS))
    counted = tokens.filter(F.col("token").isNotNull() & ~F.col("token").isin(dims.SPECIAL_TOKENS)).groupBy("token").agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_frequency)
    top = counted.orderBy(F.desc("freq"), "token").limit(room)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("k"), "token"))).alias("all")).select(F.posexplode("all").alias("pos", "x"))
    ranked = ranked.select("x.token", (F.col("pos") + len(dims.SPECIAL_TOKENS)).cast("long").alias("id"), (-F.col("x.k")).alias("freq"))
    special = tokens.sparkSession.createDataFrame([(t, i, 0) for i, t in enumerate(dims.SPECIAL_TOKENS)], "token string, id long, freq long")
    return special.union(ranked)


def encode(tokens: DataFrame, vocab: DataFrame, key: str, order: str, max_length: int | None = None) -> DataFrame:
    """key, input_ids, attention_mask of rows (key, order, token): unknown tokens are <UNK>; cut and padded on the right to `max_length` if given."""
    unknown, pad = dims.SPECIAL_TOKENS.index("<UNK>"), dims.SPECIAL_TOKENS.index("<PAD>")
    met = tokens.join(vocab.select("token", F.col("id").alias("__id")), "token", "left").withColumn("__id", F.coalesce("__id", F.lit(unknown).cast("long")))
    out = met.groupBy(key).agg(ordered("__id", order).alias("ids"))
    if max_length is None:
        return out.select(key, F.col("ids").alias("input_ids"), F.transform("ids", lambda _: F.lit(1)).alias("attention_mask"))
    cut = F.slice("ids", 1, max_length)
    gap = F.lit(max_length) - F.size(cut)
    return out.select(key, F.concat(cut, F.array_repeat(F.lit(pad).cast("long"), gap)).alias("input_ids"), F.concat(F.transform(cut, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap)).alias("attention_mask"))


def vocabulary_summary(vocab: DataFrame) -> DataFrame:
    special = F.col("token").isin(dims.SPECIAL_TOKENS)
    return vocab.agg(F.count("*").alias("vocab_size"), F.sum(special.cast("long")).alias("n_special"), F.sum("freq").alias("n_tokens"))
