"""Text as columns: normal form, ids, class codes, messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The white space that normalisation collapses, for Java and RE2.
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The classes, their codes, and the prompt that names them.
CLASS_NAMES = ("World", "Sports", "Business", "Sci/Tech")
CLASS_CODES = ("A", "B", "C", "D")
SYSTEM_PROMPT = (
    "Classify the news article into exactly one topic. "
    "Allowed codes: A=World; B=Sports; C=Business; D=Sci/Tech. "
    "Return one code only: A, B, C, or D. Do not explain."
)
USER_PROMPT = ("Article:\n", "\n\nTopic code:")


def normalize_text(text: Column) -> Column:
    """White space runs become one blank, none is left at the ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(text, f"[{SPACE}]+", " "), "^ | $", "")


def is_blank(text: Column) -> Column:
    """True for a null text and for one of nothing but white space."""
    return F.coalesce(~text.rlike(f"[^{SPACE}]"), F.lit(True))


def content_id(text: Column) -> Column:
    """SHA-256 of the normalised text; null for a null text."""
    return F.sha2(normalize_text(text), 256)


def row_id(split: Column | str, index: Column, label: Column, text: Column) -> Column:
    """SHA-256 of split, index, label and raw text with NUL between; null if any is null."""
    split = F.lit(split) if isinstance(split, str) else split
    nul = F.lit("\0")
    return F.sha2(F.concat(split, nul, index.cast("string"), nul, label.cast("string"), nul, text), 256)


def order_hash(seed: Column | int, key: Column) -> Column:
    """The hash that orders the rows of a class: SHA-256 of seed, NUL, key."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.sha2(F.concat(seed.cast("string"), F.lit("\0"), key), 256)


def hash_fraction(digest: Column) -> Column:
    """A hex digest's first 52 bits as a number in [0, 1), in the digest's order."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _lookup(values: tuple, keys: tuple, key: Column) -> Column:
    pairs = [F.lit(x) for k, v in zip(keys, values) for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key)


def code_of(label: Column) -> Column:
    """The code of a label; null outside 0..3."""
    return _lookup(CLASS_CODES, (0, 1, 2, 3), label.cast("int"))


def name_of(label: Column) -> Column:
    return _lookup(CLASS_NAMES, (0, 1, 2, 3), label.cast("int"))


def parse_code(answer: Column) -> Column:
    """The label an answer names: white space, then quotes and backticks are stripped.

    Anything but one bare code in either case gives null, as does null.
    """
    bare = F.regexp_replace(answer, f"^[{SPACE}]+|[{SPACE}]+$", "")
    bare = F.upper(F.regexp_replace(bare, "^[\"'`]+|[\"'`]+$", ""))
    return _lookup((0, 1, 2, 3), CLASS_CODES, bare)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_content(text: Column) -> Column:
    return F.concat(F.lit(USER_PROMPT[0]), normalize_text(text), F.lit(USER_PROMPT[1]))


def inference_messages(text: Column) -> Column:
    """System and user message of a text; the user content is null for a null text."""
    return F.array(_message("system", F.lit(SYSTEM_PROMPT)), _message("user", user_content(text)))


def training_messages(text: Column, label: Column) -> Column:
    """The inference messages and the answer; null for a label outside 0..3."""
    whole = F.concat(inference_messages(text), F.array(_message("assistant", code_of(label))))
    return F.when(code_of(label).isNotNull(), whole)


def render_chat(messages: Column, opening: str = "<|{role}|>\n", closing: str = "\n", answer_role: str | None = "assistant") -> Column:
    """Messages as one string by a template: ``opening`` with the role, content, ``closing``.

    With ``answer_role`` the string ends with that role's opening, which asks for
    an answer; without, it ends after the last message.
    """
    before, _, after = opening.partition("{role}")
    one = F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"], F.lit(closing)))
    text = F.array_join(one, "")
    return F.concat(text, F.lit(before + answer_role + after)) if answer_role else text


def scientific(log10: Column) -> Column:
    """10^x as mantissa and exponent, for x far below what a double holds.

    The mantissa has 12 significant digits without trailing zeros.
    """
    exponent = F.floor(log10)
    mantissa = F.round(F.pow(F.lit(10.0), log10 - exponent), 11)
    return F.concat(F.regexp_replace(mantissa.cast("string"), r"\.0$", ""), F.lit("e"), exponent.cast("string"))


def parameter_text(trainable: Column, percent: Column, total: Column) -> Column:
    """``1,234 (0.1234% of 1,000,000)``; null where the numbers contradict each other."""
    exact = F.lit(100.0) * trainable / F.nullif(total, F.lit(0))
    fits = (trainable > 0) & (total >= trainable) & (percent > 0) & (F.abs(percent - exact) <= 1e-6 * F.greatest(F.abs(percent), F.abs(exact)))
    text = F.concat(F.format_number(trainable, 0), F.lit(" ("), F.format_string("%.4f", percent.cast("double")), F.lit("% of "), F.format_number(total, 0), F.lit(")"))
    return F.when(fits, text)
