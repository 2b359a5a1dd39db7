"""Column expressions over answers, labels, ids and prompts; all stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that count as a direction, and the labels' aliases.
INCREASE = ("increase", "increases")
DECREASE = ("decrease", "decreases")
INCREASE_SYNONYMS = tuple("increase increases increasing rise rises rising upward upwards faster accelerate accelerates accelerating".split())
DECREASE_SYNONYMS = tuple("decrease decreases decreasing fall falls falling downward downwards slower decline declines declining decelerate decelerates decelerating".split())
LABELS = {"increase": "increase", "up": "increase", "upward": "increase", "increased": "increase", "decrease": "decrease", "down": "decrease", "downward": "decrease", "decreased": "decrease"}
TERNARY = {"increase": "increase", "increases": "increase", "decrease": "decrease", "decreases": "decrease", "constant": "constant"}
YES_NO = {"yes": "yes", "no": "no"}
MODEL_ALIASES = {
    "moonshotai/kimi-audio-7b-instruct": "kimi-audio",
    "nvidia/audio-flamingo-3-hf": "audioflamingo3",
    "stepfun-ai/step-audio-2-mini": "step-audio-2-mini",
    "xiaomimimo/mimo-audio-7b-instruct": "mimo-audio",
}
SPACE = r"(?U)\s+"


def whole_word(col: Column, words: Sequence[str]) -> Column:
    """Whether any of the words stands in the text between word edges, in any case; null counts as empty."""
    return F.coalesce(col, F.lit("")).rlike(r"(?iU)\b(?:" + "|".join(words) + r")\b")


def parse_direction_synonyms(col: Column, inc: Sequence[str] = INCREASE_SYNONYMS, dec: Sequence[str] = DECREASE_SYNONYMS) -> Column:
    """The direction if words of exactly one occur, else null; negation does not count."""
    up, down = whole_word(col, inc), whole_word(col, dec)
    return F.when(up & ~down, "increase").when(down & ~up, "decrease")


def parse_direction(col: Column) -> Column:
    return parse_direction_synonyms(col, INCREASE, DECREASE)


def is_ambiguous(col: Column, inc: Sequence[str] = INCREASE, dec: Sequence[str] = DECREASE) -> Column:
    return whole_word(col, inc) & whole_word(col, dec)


def needs_retry(col: Column) -> Column:
    """No direction word at all; an ambiguous answer is not asked again."""
    return ~whole_word(col, INCREASE + DECREASE)


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out


def parse_first_label(col: Column, aliases: Mapping[str, str]) -> Column:
    """The label of the whole answer, or else of the first of the words in it; null without any."""
    low = F.lower(F.trim(col))
    words = "|".join(sorted(aliases, key=lambda w: (-len(w), w)))
    return F.coalesce(_lookup(low, aliases), _lookup(F.regexp_extract(low, rf"(?U)\b({words})\b", 1), aliases))


def normalize_label(col: Column) -> Column:
    return _lookup(F.lower(F.trim(col)), LABELS)


def prediction_for_row(raw: Column, error: Column, synonyms: Column) -> Column:
    """Null on an error; else the parse by the wider words where `synonyms` is true, by the main ones elsewhere."""
    failed = error.isNotNull() & (error != "")
    return F.when(failed, F.lit(None)).when(F.coalesce(synonyms, F.lit(False)), parse_direction_synonyms(raw)).otherwise(parse_direction(raw))


def normalize_text(col: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(col, SPACE, " "))


def canonical_accent(col: Column, groups: Sequence[str]) -> Column:
    """The first group whose name the text contains, in any case; `Others` without one."""
    low, out = F.lower(F.coalesce(col, F.lit(""))), F
    for g in groups:
        out = out.when(low.contains(g.lower()), g)
    return out.otherwise("Others")


def canonical_gender(col: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(low.isin("m", "male", "man"), "male").when(low.isin("f", "female", "woman"), "female").otherwise("unknown")


def safe_filename(col: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen stay, others become underscores; null for an empty name."""
    name = F.regexp_replace(F.trim(col), r"[^\p{L}\p{N}._-]", "_")
    return F.when(F.length(name) > 0, F.concat(name, F.lit(".wav")))


def stable_seed(*cols: Column) -> Column:
    """The first eight bytes of SHA-256 of the values joined by colons, as an unsigned number."""
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_order(seed: object, *cols: Column) -> Column:
    """A key whose order is a shuffle that no partitioning changes; the columns break ties after it."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


CLIP_PARTS = ("source_id", "clip", "curve", "tier", "direction")


def split_clip_id(col: Column) -> Column:
    """`source__clip__curve__tier__direction` as a struct, from the right; the source may hold `__` itself."""
    parts = F.split(col, "__")
    last = lambda k: F.try_element_at(parts, F.lit(-k))
    source = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 4, F.lit(0))), "__")
    return F.struct(source.alias("source_id"), *[last(4 - i).alias(n) for i, n in enumerate(CLIP_PARTS[1:])])


def curve_progress(t: Column, mode: Column, jump_at: float | Column = 0.5) -> Column:
    """Progress of 0 to 1 along a curve; an unknown mode raises."""
    at = F.lit(jump_at) if isinstance(jump_at, float) else jump_at
    return (
        F.when(mode == "linear", t)
        .when(mode.isin("quad_first_flat", "quadratic_flat_first"), t * t)
        .when(mode.isin("quad_last_flat", "quadratic_flat_last"), 1.0 - (1.0 - t) * (1.0 - t))
        .when(mode == "jump", F.when(t < at, 0.0).otherwise(1.0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown curve mode: "), F.coalesce(mode, F.lit("null")))).cast("double"))
    )


def step_progress(i: Column, n: Column, mode: Column, jump_at: float | Column = 0.5) -> Column:
    """Progress of step i of n; a single step is complete."""
    return curve_progress(F.when(n <= 1, F.lit(1.0)).otherwise(F.try_divide(i.cast("double"), (n - 1).cast("double"))), mode, jump_at)


def build_prompt(category: Column, swap: bool = False, clip_reference: bool = False) -> Column:
    """The question for a category; swap: decrease first; clip_reference: names the clip."""
    first, second = ("decrease", "increase") if swap else ("increase", "decrease")
    tail = " of this audio clip" if clip_reference else ""
    ask = f'{tail} {first} or {second} over time?\n\nAnswer with only one word: "{first}" or "{second}".'
    return F.concat(F.lit("Does the "), F.regexp_replace(category, "_", " "), F.lit(ask))


def build_format_prompt(category: Column, kind: str) -> Column:
    """The question in yes/no or three-way form."""
    ask = {
        "yes_no": ("Does the ", ' vary with time?\n\nAnswer with only one word: "yes" or "no".'),
        "ternary": ("How does the ", ' vary with time?\n\nAnswer with only one word: "increase", "decrease" or "constant".'),
    }[kind]
    return F.concat(F.lit(ask[0]), F.regexp_replace(category, "_", " "), F.lit(ask[1]))


def build_option_prompt(task: str, labels: Sequence[str]) -> str:
    """A question with lettered options."""
    options = "\n".join(f"{chr(65 + i)}. {label}" for i, label in enumerate(labels))
    return f"What is the speaker's {task} in this audio?\n\nOptions:\n{options}\n\nAnswer with only the option letter."


def argmax_option(scores: Column, order: Sequence[str]) -> Column:
    """The option with the largest finite score of a map; of equal ones the first in `order`; null without any."""
    keys = F.array(*[F.lit(k) for k in order])
    pairs = F.transform(keys, lambda k, i: F.struct(F.try_element_at(scores, k).alias("v"), (-i).alias("at"), k.alias("k")))
    fine = F.filter(pairs, lambda x: x["v"].isNotNull() & ~F.isnan(x["v"]) & (F.abs(x["v"]) < float("inf")))
    return F.array_max(fine)["k"]


def softmax_options(scores: Column) -> Column:
    """Probabilities over the options of a map of scores."""
    top = F.array_max(F.map_values(scores))
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform_values(scores, lambda _, v: F.exp(v - top) / total)


def model_slug(col: Column) -> Column:
    """A model id as a short stem: known aliases, else its last part."""
    low = F.lower(col)
    return F.coalesce(_lookup(low, MODEL_ALIASES), F.element_at(F.split(low, "/"), -1))


def model_stem(col: Column) -> Column:
    """As model_slug, with other characters than letters and digits to single hyphens."""
    low = F.lower(col)
    other = F.regexp_replace(F.element_at(F.split(low, "/"), -1), "[^a-z0-9]+", "-")
    return F.coalesce(_lookup(low, MODEL_ALIASES | {"gemini-3-flash-preview": "gemini-3-flash"}), F.regexp_replace(other, "^-+|-+$", ""))


# Per category the other wordings of its question, each with a name and its words for increase and decrease.
PARAPHRASES = {
    "volume": [
        ("rise_fall", "Does the loudness rise or fall as the audio progresses?", "rise", "fall"),
        ("intensity_increase_decrease", "Does the sound intensity increase or decrease throughout the recording?", "increase", "decrease"),
        ("intensity_increasing_decreasing", "Is the audio intensity increasing or decreasing over time?", "increasing", "decreasing"),
    ],
    "voice_pitch": [
        ("tone_rise_fall", "Does the tone rise or fall over time?", "rise", "fall"),
        ("frequency_upward_downward", "Does the sound frequency change upward or downward over time?", "upward", "downward"),
        ("frequency_rise_decline", "Over time, does the frequency of the voice rise or decline?", "rise", "decline"),
    ],
    "speaking_speed": [
        ("pace_faster_slower", "Does the pace of speech become faster or slower over time?", "faster", "slower"),
        ("tempo_increase_decrease", "Does the speech tempo increase or decrease with time?", "increase", "decrease"),
        ("delivery_accelerate_decelerate", "Does the pace of delivery accelerate or decelerate over time?", "accelerate", "decelerate"),
    ],
}


def paraphrased_prompts(category: Column) -> Column:
    """Array of (variant, prompt, increase_word, decrease_word): the other wordings of a category's question; else empty."""

    def of(name: str, question: str, up: str, down: str) -> Column:
        prompt = f'{question}\n\nAnswer with only one word: "{up}" or "{down}".'
        values = {"variant": name, "prompt": prompt, "increase_word": up, "decrease_word": down}
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    kind = "array<struct<variant:string,prompt:string,increase_word:string,decrease_word:string>>"
    out = F.array().cast(kind)
    for name, variants in PARAPHRASES.items():
        out = F.when(category == name, F.array(*[of(*v) for v in variants])).otherwise(out)
    return out
