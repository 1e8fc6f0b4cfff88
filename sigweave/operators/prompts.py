"""Training examples as text: prompts, explanations, conversations and contrasts, as string expressions.

`tokens` is an array<string> column, `label` an integer column; texts live in `dims`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave import dims
from sigweave.operators.sampling import choice, per_class


def by_label(label: Column, values: dict[int, str], default: str | Column = "unknown") -> Column:
    out = F.lit(default) if isinstance(default, str) else default
    for k, v in values.items():
        out = F.when(label == k, v).otherwise(out)
    return F.when(label.isNotNull(), out)


def task_name(label: Column) -> Column:
    return by_label(label, {x.id: x.name for x in dims.MOTOR_LABELS})


def joined(tokens: Column, longest: int | None = None) -> Column:
    """The tokens as one string; ten fewer than `longest` if given."""
    return F.array_join(F.slice(tokens, 1, longest - 10) if longest else tokens, " ")


def _said(special: bool, *parts: Column | str) -> Column:
    marks = {"<BOS>", "<SEP>", "<EOS>"}
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p for p in parts if special or not (isinstance(p, str) and p in marks)))


def classification(tokens: Column, label: Column | None = None, longest: int = 512, special: bool = True) -> Column:
    said = F.concat(F.lit("Prediction: "), task_name(label)) if label is not None else F.lit(None).cast("string")
    return _said(special, "<BOS>", dims.CLASSIFY, joined(tokens, longest), "<SEP>", said, "<EOS>")


def inference(tokens: Column, longest: int = 512, special: bool = True) -> Column:
    return _said(special, "<BOS>", dims.CLASSIFY, joined(tokens, longest), "<SEP>", "Prediction:")


def explanation_prompt(tokens: Column, label: Column, confidence: Column | None = None, special: bool = True) -> Column:
    name = task_name(label)
    start = F.concat(F.lit("Analysis: The EEG pattern indicates "), name, F.lit(" because"))
    if confidence is not None:
        start = F.concat(start, F.lit(" (confidence: "), F.format_string("%.2f", F.bround(confidence, 2)), F.lit(")"))
    return _said(special, "<BOS>", F.concat(F.lit("Explain "), name, F.lit(" prediction:")), joined(tokens), "<SEP>", start)


def has(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def explanation(tokens: Column, label: Column) -> Column:
    """A sentence from what the tokens hold; only its first letter is a capital."""
    text = F.lower(joined(tokens))
    parts = [
        F.when(has(text, "beta"), F.when(label.isin(1, 2), dims.REASONS["beta_hands"]).otherwise(dims.REASONS["beta"])),
        F.when(has(text, "alpha"), dims.REASONS["alpha"]),
        F.when(has(text, "left") & (label == 2), dims.REASONS["left"]).when(has(text, "right") & (label == 1), dims.REASONS["right"]),
    ]
    said = F.concat_ws(". ", *parts)
    said = F.when(said == "", F.concat(F.lit("EEG patterns consistent with "), task_name(label), F.lit(" motor imagery"))).otherwise(said)
    return F.concat(F.upper(F.left(said, F.lit(1))), F.lower(F.substring(said, 2, 1 << 30)), F.lit("."))


def messages(tokens: Column, label: Column | None = None) -> Column:
    """Turns of a conversation: system, user, and the assistant's if there is a label."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    ask = [turn("system", F.lit(dims.SYSTEM)), turn("user", F.concat(F.lit(dims.ASK), joined(tokens)))]
    if label is None:
        return F.array(*ask)
    answer = F.concat(F.lit(dims.ANSWER), task_name(label), F.lit(". "), explanation(tokens, label))
    return F.when(label.isNull(), F.array(*ask)).otherwise(F.array(*ask, turn("assistant", answer)))


def training_pairs(df: DataFrame, explanations: bool = True) -> DataFrame:
    """input, output, task, label: a classification row and, if asked for, an explanation row for each of `df` (tokens, label)."""
    tokens, label = F.col("tokens"), F.col("label")
    row = lambda a, b, task: F.struct(a.alias("input"), b.alias("output"), F.lit(task).alias("task"))
    rows = [row(inference(tokens), task_name(label), "classification")]
    rows += [row(explanation_prompt(tokens, label), explanation(tokens, label), "explanation")] if explanations else []
    others = [c for c in df.columns if c not in ("tokens", "label")]
    return df.select(*others, "label", F.inline(F.array(*rows)))


def enhanced(template: Column, tokens: Column) -> Column:
    text = F.lower(joined(tokens))
    return F.concat_ws(" ", template, *(F.when(has(text, *words), said) for words, said in dims.ENHANCEMENTS))


def _template(label: Column, key: str, seed: int | str) -> Column:
    out = F.lit("Generic pattern.")
    for x in dims.MOTOR_LABELS:
        out = F.when(label == x.id, choice(list(x.explanations), key, seed)).otherwise(out)
    return out


def synthetic_explanations(df: DataFrame, key: str, variations: int = 3, seed: int = 42) -> DataFrame:
    """Adds variation, template, explanation: some drawn templates for each row, enhanced by what its tokens hold."""
    made = [F.struct(F.lit(k).alias("variation"), _template(F.col("label"), key, f"{seed}-{k}").alias("template")) for k in range(variations)]
    rows = df.select("*", F.inline(F.array(*made)))
    return rows.withColumn("explanation", enhanced(F.col("template"), F.col("tokens")))


def instruction_tuning(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    data = joined(F.col("tokens"))
    said = enhanced(_template(F.col("label"), key, f"{seed}-text"), F.col("tokens"))
    return df.select(key, F.concat(choice(dims.INSTRUCTIONS, key, f"{seed}-ask"), F.lit("\n\nEEG Data: "), data).alias("instruction"), data.alias("input"), F.concat(F.lit("This EEG pattern indicates "), task_name(F.col("label")), F.lit(". "), said).alias("output"), "label", task_name(F.col("label")).alias("task_name"))


def augmented(tokens: Column, key: str, probability: float = 0.1, swap: float = 1.0, soften: float = 0.1, seed: int = 42) -> Column:
    """With some probability: one adjacent pair of more than four tokens swapped, and some high or low ones made medium."""
    from sigweave.operators.sampling import draw

    number = lambda salt: F.conv(F.substring(draw(key, f"{seed}-{salt}"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    n = F.size(tokens)
    at = F.floor(number("swap") * (n - 1)).cast("int")
    swapped = F.when((n > 4) & F.lit(swap > 0), F.transform(tokens, lambda t, i: F.when(i == at, F.get(tokens, at + 1)).when(i == at + 1, F.get(tokens, at)).otherwise(t))).otherwise(tokens)
    luck = lambda i: F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}-soft-"), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    soft = F.transform(swapped, lambda t, i: F.when(luck(i) >= soften, t).when(F.contains(t, F.lit("_HIGH")), F.replace(t, F.lit("_HIGH"), F.lit("_MEDIUM"))).when(F.contains(t, F.lit("_LOW")), F.replace(t, F.lit("_LOW"), F.lit("_MEDIUM"))).otherwise(t))
    return F.when(number("any") <= probability, soft).otherwise(tokens)


def few_shot(df: DataFrame, key: str, n: int = 3, seed: int = 42) -> DataFrame:
    """At most n rows of each class as `EEG: ... -> Task: ...`."""
    rows = per_class(df, key, "label", n, seed)
    return rows.withColumn("task_name", task_name(F.col("label"))).withColumn("formatted", F.concat(F.lit("EEG: "), joined(F.col("tokens")), F.lit(" -> Task: "), F.col("task_name")))


def chain_of_thought(df: DataFrame) -> DataFrame:
    """Adds reasoning and conclusion."""
    text, label = F.lower(joined(F.col("tokens"))), F.col("label")
    short = by_label(label, {x.id: x.short for x in dims.MOTOR_LABELS})
    spatial = F.lit(None).cast("string")
    for x in dims.MOTOR_LABELS:
        spatial = F.when(label == x.id, x.spatial).otherwise(spatial)
    steps = F.concat_ws("\n", F.lit(dims.STEPS[0]), *(F.when(has(text, *words), said) for words, said in dims.OBSERVATIONS), F.lit(dims.STEPS[1]), spatial, F.lit(dims.STEPS[2]), F.concat(F.lit("- Pattern consistent with "), short, F.lit(" motor imagery")))
    return df.withColumn("reasoning", steps).withColumn("conclusion", F.concat(F.lit("Therefore, this represents "), short, F.lit(" motor imagery.")))


def differences(a: Column, b: Column, label_a: Column, label_b: Column) -> Column:
    """What tells two token sequences apart: sides of two hand tasks, then bands of only one of them (in order of name)."""
    one, two = F.lower(joined(a)), F.lower(joined(b))
    hands = label_a.isin(1, 2) & label_b.isin(1, 2)
    sides = F.when(hands & has(one, "left") & has(two, "right"), dims.CONTRASTS["left_right"]).when(hands & has(one, "right") & has(two, "left"), dims.CONTRASTS["right_left"])
    bands = lambda t: F.filter(F.array(*map(F.lit, ("alpha", "beta", "gamma", "theta"))), lambda x: F.contains(t, x))
    only = lambda x, y, which: F.when(F.size(F.array_except(bands(x), bands(y))) > 0, F.concat(F.lit("unique "), F.array_join(F.array_sort(F.array_except(bands(x), bands(y))), ", "), F.lit(f" activity in {which} task")))
    said = F.concat_ws(", ", sides, only(one, two, "first"), only(two, one, "second"))
    return F.when(said == "", dims.CONTRASTS["none"]).otherwise(said)


def contrastive(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One row for each pair of classes: a drawn sequence of each, and how they differ. At most one row of a class is joined."""
    rows = per_class(df, key, "label", 1, seed).withColumn("task", by_label(F.col("label"), {x.id: x.short for x in dims.MOTOR_LABELS}))
    a, b = (rows.select(F.col("label").alias(f"label{i}"), F.col("task").alias(f"task{i}"), F.col("tokens").alias(f"tokens{i}")) for i in (1, 2))
    met = a.join(b, F.col("label1") < F.col("label2"))
    title = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))
    text = F.concat(F.lit("Compare "), F.col("task1"), F.lit(" vs "), F.col("task2"), F.lit(" motor imagery:\n\n"), title(F.col("task1")), F.lit(": "), joined(F.col("tokens1")), F.lit("\n"), title(F.col("task2")), F.lit(": "), joined(F.col("tokens2")), F.lit("\n\nKey differences: "), differences(F.col("tokens1"), F.col("tokens2"), F.col("label1"), F.col("label2")))
    return met.withColumn("contrast_explanation", text)


#: What answers are read as.
SYNONYMS = {"memory": "memory", "mem": "memory", "mathematic": "mathematic", "math": "mathematic", "mathematics": "mathematic", "music": "music", "eyesopen": "eyesopen", "open": "eyesopen", "eyesclosed": "eyesclosed", "closed": "eyesclosed"}


def parsed_answer(text: Column, marker: str = "Prediction:") -> Column:
    """The first word after the last marker, lower-cased; `unknown` if blank."""
    word = F.lower(F.regexp_extract(F.element_at(F.split(text, marker), -1), r"^\s*(\S+)", 1))
    return F.when(word == "", "unknown").otherwise(word)


def canonical(answer: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv)), answer), F.lit("unknown"))


FORMATS = ("classification", "inference", "explanation", "conversation")


def encoded(df: DataFrame, kind: str) -> DataFrame:
    """Adds text by format (messages for conversations); an explanation without a label is an inference prompt."""
    tokens, label = F.col("tokens"), F.col("label") if "label" in df.columns else F.lit(None).cast("int")
    made = {"classification": lambda: classification(tokens, label), "inference": lambda: inference(tokens), "explanation": lambda: F.when(label.isNull(), inference(tokens)).otherwise(explanation_prompt(tokens, label)), "conversation": lambda: messages(tokens, label)}
    if kind not in made:
        raise ValueError(f"unknown format {kind!r}")
    return df.withColumn("text", made[kind]())
