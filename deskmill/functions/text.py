"""Column functions on words, titles, answers and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskmill.functions import fixed as X


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once. Without it, a value that a lambda
    refers to is put into the lambda and computed anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(col: Column) -> Column:
    """Any white space off both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def fold(col: Column) -> Column:
    return F.translate(col, "ёЁ", "еЕ")


def words(col: Column, pattern: str = X.WORD) -> Column:
    return F.regexp_extract_all(col, F.lit(f"({pattern})"), F.lit(1))


def _listed(endings: list[str]) -> str:
    return "(?:" + "|".join(sorted(dict.fromkeys(endings), key=len, reverse=True)) + ")"


def stem_pattern(ru: list[str], en: list[str] | None) -> tuple[str, int]:
    """Pattern over lower-case words, and the number of its groups: what stays when the longest listed ending is cut.

    Four letters stay at least, else exactly three. English endings are for words without Cyrillic letters.
    """
    cut = [f"^(.{{4,}}?){_listed(ru)}$", f"^(.{{3}}){_listed(ru)}$"]
    if en:
        cut[1:1] = [f"^([^а-яё]{{4,}}?){_listed(en)}$"]
        cut.append(f"^([^а-яё]{{3}}){_listed(en)}$")
    return "|".join(cut), len(cut)


def cut_ending(low: Column, ru: list[str] = X.RU_ENDINGS, en: list[str] | None = None) -> Column:
    pattern, groups = stem_pattern(ru, en)
    return F.regexp_replace(low, pattern, "".join(f"${i + 1}" for i in range(groups)))


def stem(word: Column, ru: list[str] = X.RU_ENDINGS, en: list[str] | None = None) -> Column:
    return cut_ending(F.lower(fold(word)), ru, en)


def is_identifier(word: Column) -> Column:
    """A name from code: underscore, digit or a capital after the first letter."""
    return word.rlike(r"_|\d|^.+\p{Lu}")


def camel_words(name: Column) -> Column:
    return F.transform(words(name, X.CAMEL), F.lower)


def count_of(text: Column, needle: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def classify_product(title: Column, text: Column, rules=None, default: str = X.DEFAULT_PRODUCT) -> Column:
    """Product with most keyword hits in title and text start; the first rule wins a tie."""
    rules = X.PRODUCT_RULES if rules is None else rules
    hay = F.replace(F.lower(F.concat(title, F.lit(" "), F.substring(text, 1, 3000))), F.lit("ё"), F.lit("е"))
    scores = []
    for i, (name, keys) in enumerate(rules):
        total = sum((count_of(hay, k) for k in keys[1:]), count_of(hay, keys[0]))
        scores.append(F.struct(total.alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["name"]).otherwise(default)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def title_from_name(name: Column, copy_words: tuple[str, ...] = ("копия",)) -> Column:
    """File name without extension, copy marks and leading numbering."""
    bare = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    tail = r"(?iu)(\s*[—-]\s*(?:%s)|\s*\(\d+\))+$" % "|".join(copy_words)
    bare = F.regexp_replace(bare, tail, "")
    clean = strip(F.regexp_replace(bare, r"^[\s!+.\d]+", ""))
    return F.when(clean != "", clean).otherwise(bare)


def clean_answer(text: Column) -> Column:
    """Answer text without system tags, paths, tool names and markup."""
    steps = [(X.SYSTEM_TAG, ""), (X.WINDOWS_PATH, X.HIDDEN_PATH), (X.UNIX_PATH, X.HIDDEN_PATH), (X.TOOL_NAME, ""), (X.CODE_FENCE, ""),
             (X.HEADING, ""), (X.BOLD, "$1$2"), (r"\n{3,}", "\n\n")]
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return strip(text)


def split_message(text: Column, limit: int) -> Column:
    """Message parts of at most ``limit`` characters, cut at blank lines, else lines, else spaces."""
    pieces_of = (rf"(?s)(.{{1,{limit}}}\z|.{{1,{limit - 1}}}(?=\n)|.{{1,{limit - 1}}}(?= )|.{{{limit}}})")
    blocks = F.flatten(F.transform(F.split(text, "\n\n"), lambda b, i: F.when(i == 0, F.array(b)).otherwise(F.array(F.lit("\n\n"), b))))
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("parts"), F.lit("").alias("cur"))

    def keep(cur):
        return F.when(strip(cur) != "", F.array(strip(cur))).otherwise(none)

    def step(s, block):
        cut = F.regexp_extract_all(block, F.lit(pieces_of), F.lit(1))
        last = F.when(F.size(cut) > 0, F.element_at(cut, -1)).otherwise(F.lit(""))
        head = F.transform(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))), strip)
        fits = F.length(s["cur"]) + F.length(block) <= limit
        return F.struct(F.when(fits, s["parts"]).otherwise(F.concat(s["parts"], keep(s["cur"]), head)).alias("parts"),
                        F.when(fits, F.concat(s["cur"], block)).otherwise(last).alias("cur"))

    whole = F.aggregate(blocks, start, step, lambda s: F.concat(s["parts"], keep(s["cur"])))
    return F.when(F.length(text) == 0, none).when(F.length(text) <= limit, F.array(text)).otherwise(whole)


def wrap(text: Column, limit: int, at: str) -> Column:
    """Greedy packing: the longest runs of whole pieces (parted by the character ``at``) within ``limit``.

    A single piece longer than the limit stays whole.
    """
    piece = rf"((?s)[^{at}](?:.{{0,{limit - 2}}}[^{at}])?(?=[{at}]|\z)|[^{at}]+)"
    return F.regexp_extract_all(text, F.lit(piece), F.lit(1))


def chunk_text(text: Column, target: int = 1200, hard: int = 2000) -> Column:
    """Chunks of whole paragraphs; paragraphs over the hard limit are first split between words."""
    paragraphs = F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(
        F.length(p) > hard, wrap(F.regexp_replace(p, r"(?U)\s+", " "), target, " ")).otherwise(F.array(p))))
    return wrap(F.array_join(pieces, "\n"), target, r"\n")


def safe_file_name(name: Column, ext: str) -> Column:
    """File name without path and unsafe characters, at most 100 characters before the forced suffix."""
    base = base_name(F.translate(name, "\\", "/"))
    base = F.regexp_replace(F.regexp_replace(base, r"(?U)[^\w\s.,()№-]+", "_"), r"^[ ._]+|[ ._]+$", "")
    base = F.when(base == "", "файл").otherwise(base)
    bare = F.when(F.lower(base).endswith(ext), F.expr("''") if not ext else F.regexp_replace(base, r".{%d}$" % len(ext), "")
                  ).otherwise(F.regexp_replace(base, r"(?<=[^.])\.[^.]+$", ""))
    return F.concat(F.substring(bare, 1, 100), F.lit(ext))


def redact(text: Column, secrets: list[str]) -> Column:
    for s in secrets:
        if s:
            text = F.replace(text, F.lit(s), F.lit("***"))
    return text


def limit_reset(text: Column, now: Column) -> Column:
    """struct(hit, reset): is it a limit message, and when the limit ends if it says so."""
    hit = F.coalesce(text.rlike(X.LIMIT_HIT), F.lit(False))
    said = [F.regexp_extract(text, X.LIMIT_CLOCK, i) for i in (1, 2, 3)]
    twelve = F.lower(said[2]) != ""
    # a twelve-hour clock counts 12 as 0, and the afternoon starts at 12
    hour = said[0].try_cast("int")
    later = F.lower(said[2]) == "pm"
    hour = F.when(twelve & (hour == 12), 0).otherwise(hour) + F.when(later & (hour <= 12), 12).otherwise(0)
    minute = F.coalesce(said[1].try_cast("int"), F.lit(0))
    today = F.date_trunc("day", now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute, F.lit(0))
    coming = today + F.when(today <= now, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    stamp = F.nullif(F.regexp_extract(text, X.LIMIT_STAMP, 1), F.lit(""))
    by_stamp = F.timestamp_seconds(stamp.try_cast("long")).cast("timestamp_ntz")
    reset = F.coalesce(by_stamp, F.when(hour.between(0, 23) & (minute < 60), coming))
    return F.struct(hit.alias("hit"), F.when(hit, reset).alias("reset"))


def first_comment(body: Column, mark: str = "//", headings: tuple[str, ...] = (
        "параметры", "возвращаемое значение", "parameters", "returns")) -> Column:
    """First sentence of the comment block at the top, up to a section heading or an empty comment line."""
    lines = F.transform(F.split(body, "\n"), strip)
    stop = F.array_position(F.transform(lines, lambda s: s.startswith(mark)), F.lit(False))
    block = F.slice(lines, 1, F.when(stop > 0, stop.cast("int") - 1).otherwise(F.size(lines)))
    bare = F.transform(block, lambda s: strip(F.regexp_replace(s, r"^/+", "")))
    ends = F.transform(bare, lambda s, i: F.lower(F.regexp_replace(s, r":+$", "")).isin(list(headings)))
    cut = F.array_position(ends, F.lit(True))
    bare = F.slice(bare, 1, F.when(cut > 0, cut.cast("int") - 1).otherwise(F.size(bare)))
    # empty lines before the first words are passed over, one after them ends the block
    text = F.regexp_extract(F.array_join(bare, "\n"), r"(?s)^\n*(.*?)(?:\n\n|\n*\z)", 1)
    phrase = F.element_at(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\. ", 2), 1)
    phrase = F.regexp_replace(strip(phrase), r"\.+$", "")
    return F.concat(F.lower(F.substring(phrase, 1, 1)), F.substring(phrase, 2, 1 << 30))
