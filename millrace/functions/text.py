"""Text expressions: chat rendering, answer extraction and grading, names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------------------
ROLE_MAP = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant"}
ROLE_MAP_WITH_SYSTEM = {**ROLE_MAP, "system": "system"}
ANSWER_MARKER = "####"
THINK_END = "</think>"
BOXED = "\\boxed"
CHOICE_LETTERS = "ABCD"
MIN_CHARS = 50
PIECE_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
NUMBER_SUFFIXES = ["", "K", "M", "B", "T", "P", "E"]
BOXED_INSTRUCTION = "Please reason step by step, and put your final answer within \\boxed{}."
CHOICE_INSTRUCTION = "Answer with the letter of the correct option."
# ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChatTemplate:
    """The constant parts of a chat template; the default is ChatML."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_content: str = "<|im_end|>\n"
    generation_role: str = "assistant"


def chat_text(messages: Column, template: ChatTemplate = ChatTemplate(), add_prompt: bool = False) -> Column:
    """Render an array of (role, content) structs to one string."""
    parts = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(template.before_role), m["role"], F.lit(template.after_role), m["content"],
            F.lit(template.after_content),
        ),
    )
    text = F.array_join(parts, "")
    if add_prompt:
        text = F.concat(text, F.lit(template.before_role + template.generation_role + template.after_role))
    return text


def mapped_role(role: Column, role_map: dict[str, str] = ROLE_MAP) -> Column:
    """Role name in the target vocabulary; an unknown role fails the job."""
    out = None
    for old, new in role_map.items():
        out = F.when(role == old, F.lit(new)) if out is None else out.when(role == old, F.lit(new))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))))


def pieces(text: Column) -> Column:
    """Default tokenizer: runs of word characters, every other visible character alone."""
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def after_last(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, -1)


def gold_after_marker(answer: Column, marker: str = ANSWER_MARKER) -> Column:
    return F.replace(F.trim(after_last(answer, marker)), F.lit(","), F.lit(""))


def answer_part(text: Column) -> Column:
    return after_last(text, THINK_END)


def last_boxed(text: Column) -> Column:
    """Content of the brace group that follows the last boxed marker; NULL if absent or unbalanced.

    Works on runs ending in a brace rather than on characters, so the fold has one step per
    brace in the tail of the text.
    """
    tail = after_last(text, BOXED)
    opened = F.locate("{", tail)
    body = F.substr(tail, opened)
    # Anchored at the last match, so a long rest without braces is looked through once only.
    runs = F.regexp_extract_all(body, F.lit(r"\G[^{}]*+[{}]"), F.lit(0))
    start = F.struct(
        body.alias("body"), F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(False).alias("closed")
    )

    def step(state, run):
        depth = state["depth"] + F.when(F.endswith(run, F.lit("{")), 1).otherwise(-1)
        moved = F.struct(
            state["body"].alias("body"), depth.alias("depth"), (state["seen"] + F.length(run)).alias("seen"),
            (depth == 0).alias("closed"),
        )
        return F.when(state["closed"], state).otherwise(moved)

    def inner(state):
        return F.when(state["closed"], F.substr(state["body"], F.lit(2), state["seen"] - 2))

    return F.when((F.instr(text, BOXED) > 0) & (opened > 0), F.aggregate(runs, start, step, inner))


def pred_answer(text: Column) -> Column:
    """Last boxed group of the final answer, else of the whole text (also when the first is empty)."""
    first = last_boxed(answer_part(text))
    return F.coalesce(F.when(first != "", first), last_boxed(text))


def choice_correct(pred: Column, gold: Column) -> Column:
    """First letter A-D of the prediction equals the gold letter."""
    letter = F.regexp_extract(F.coalesce(pred, F.lit("")), "[ABCD]", 0)
    return F.coalesce((letter != "") & (letter == gold), F.lit(False))


def plain_math(answer: Column) -> Column:
    """Answer with layout commands, blanks, thousands commas and a final period removed."""
    out = F.regexp_replace(answer, r"\\(left|right|displaystyle|,|!|;| )", "")
    out = F.regexp_replace(out, r"\\[dt]frac", r"\\frac")
    out = F.regexp_replace(out, r"\\text\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"[\s$]", "")
    out = F.regexp_replace(out, r"([0-9]),(?=[0-9]{3})", "$1")
    return F.regexp_replace(out, r"\.$", "")


def math_number(plain: Column) -> Column:
    """Value of a plain number, ``a/b`` or ``\\frac{a}{b}``; NULL for anything else."""
    number = r"-?[0-9]+(?:\.[0-9]+)?"
    slash = rf"^({number})/({number})$"
    frac = rf"^(-?)\\frac\{{({number})\}}\{{({number})\}}$"

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom.try_cast("double") != 0, top.try_cast("double") / F.nullif(bottom.try_cast("double"), F.lit(0.0)))

    sign = F.when(F.regexp_extract(plain, frac, 1) == "-", -1.0).otherwise(1.0)
    return (
        F.when(plain.rlike(rf"^{number}$"), plain.try_cast("double"))
        .when(plain.rlike(slash), ratio(F.regexp_extract(plain, slash, 1), F.regexp_extract(plain, slash, 2)))
        .when(plain.rlike(frac), sign * ratio(F.regexp_extract(plain, frac, 2), F.regexp_extract(plain, frac, 3)))
    )


def same_math(pred: Column, gold: Column, pred_number: Column, gold_number: Column) -> Column:
    """Equal as cleaned text, or equal as numbers; anything that cannot be decided is wrong."""
    same = (pred == gold) & (pred != "")
    close = F.abs(pred_number - gold_number) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(gold_number))
    return F.coalesce(same, F.lit(False)) | F.coalesce(close, F.lit(False))


def math_correct(pred: Column, gold: Column) -> Column:
    p, g = plain_math(pred), plain_math(gold)
    return same_math(p, g, math_number(p), math_number(g))


def slug(name: Column) -> Column:
    """Run-name prefix: last path part, lower case, everything else an underscore."""
    trimmed = F.regexp_replace(name, "/+$", "")
    cached = F.regexp_extract(trimmed, r"(?:^|/)([^/]+)/snapshots(?:/|$)", 1)
    last = F.when(cached != "", F.substring_index(cached, "--", -1)).otherwise(F.substring_index(trimmed, "/", -1))
    return F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def shard_name(source: Column, shard: Column, shards: Column) -> Column:
    """The source alone when it has one shard, ``source_p{i}`` otherwise."""
    return F.when(shards == 1, source).otherwise(F.concat(source, F.lit("_p"), shard.cast("string")))


def short_number(n: Column) -> Column:
    """Three significant digits with a power-of-1000 suffix: 1572864000 -> 1.57B.

    Values below 1 (in absolute size) keep three significant digits and no suffix.
    """
    n = n.cast("double")
    size = F.abs(n)
    digits = F.when(size > 0, F.floor(F.log10(F.when(size > 0, size)))).otherwise(F.lit(0))
    unit = F.pow(F.lit(10.0), digits - 2)
    rounded = F.rint(n / unit) * unit
    power = F.least(F.greatest(F.floor((F.log10(F.when(F.abs(rounded) > 0, F.abs(rounded))) + 1e-12) / 3), F.lit(0)),
                    F.lit(len(NUMBER_SUFFIXES) - 1)).cast("int")
    scaled = F.coalesce(rounded / F.pow(F.lit(1000.0), power), F.lit(0.0))
    plain = F.regexp_replace(F.format_string("%.6f", scaled), r"\.?0+$", "")
    suffix = F.element_at(F.array(*[F.lit(s) for s in NUMBER_SUFFIXES]), F.coalesce(power, F.lit(0)) + 1)
    return F.concat(plain, suffix)
