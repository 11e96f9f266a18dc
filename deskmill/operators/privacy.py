"""Reversible tokens in place of personal data: by column rules and by patterns in text."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.functions import fixed as X
from deskmill.session import materialise

# What is looked for in free text, in the order in which it is replaced.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "СЧЕТ": r"\b(?:[A-Z]{2}\d{2}[A-Z0-9]{16}|\d{20})\b",
    "КАРТА": r"\b\d{4}(?:[ -]?\d{4}){3}\b",
    "ИИН": r"\b\d{12}\b",
    "ТЕЛ": r"\+\d[\d() -]{8,}\d",
}
TOKEN_DIGITS, MAX_DIGITS = 6, 64
LIST_KEYS = ("tables", "tables_all", "fields")


def normalize_rules(own: dict | None, default: dict) -> dict:
    """Own rules over the defaults; unknown categories and malformed pairs are dropped."""
    rules = {**default, **(own or {})}
    rules["enabled"] = bool(rules.get("enabled", True))
    for key in ("categories", "patterns"):
        rules[key] = [str(c) for c in rules.get(key) or [] if str(c) in X.CATEGORIES]
    for key in LIST_KEYS:
        pairs = [p for p in rules.get(key) or [] if isinstance(p, (list, tuple)) and len(p) == 2]
        rules[key] = [[str(a), str(b)] for a, b in pairs if str(a).strip()]
    rules["keep"] = [str(k) for k in rules.get("keep") or [] if str(k).strip()]
    return rules


def revision(rules: dict) -> str:
    text = json.dumps(rules, ensure_ascii=False, sort_keys=True)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]


def must_push(rules: dict, known_revision: str | None) -> bool:
    return revision(rules) != known_revision


def column_categories(table: str, schema, rules: dict) -> dict[str, str]:
    """Category of each string column to hide; ``=name`` in a field rule means the whole name."""
    if not rules["enabled"]:
        return {}
    low, out = table.lower(), {}
    whole = next((c for part, c in rules["tables_all"] if part.lower() in low), None)
    owner = next((c for part, c in rules["tables"] if part.lower() in low), None)
    for field in schema:
        if field.dataType.simpleString() != "string" or any(k.lower() == field.name.lower() for k in rules["keep"]):
            continue
        name = field.name.lower()
        by_field = next((c for part, c in rules["fields"] if (name == part[1:].lower() if part.startswith("=") else part.lower() in name)), None)
        category = by_field or whole or (owner if name.endswith("name") else None)
        if category in rules["categories"]:
            out[field.name] = category
    return out


ODD_ROWS = 100_000  # tokens that are handed to every task at most


def digest(category: Column, value: Column, salt: str) -> Column:
    return F.upper(F.sha2(F.concat(F.lit(salt), category, F.lit("|"), value), 256))


def token_dictionary(values: DataFrame, salt: str, digits: int = TOKEN_DIGITS, known: DataFrame | None = None) -> DataFrame:
    """(token, category, value) for rows (category, value). Tokens that would be shared take more digits.

    With ``known`` (token, category, value) its tokens stay as they are, and fresh values take as many digits as tell
    them from all known and fresh ones. How many that is, is found by comparing neighbours in digest order among
    the values with equal first digits, which are few.
    """
    rows = values.filter(F.col("value").isNotNull() & (F.col("value") != "")).select("category", "value").distinct()
    old = None if known is None else known.select("category", "value", F.col("token").alias("_old"))
    rows = rows.withColumn("_old", F.lit(None).cast("string")) if old is None else (
        rows.join(old, ["category", "value"], "left_anti").withColumn("_old", F.lit(None).cast("string")).unionByName(old))
    rows = rows.withColumn("d", digest(F.col("category"), F.col("value"), salt))
    w = Window.partitionBy("category", F.substring("d", 1, digits)).orderBy("d")
    near = rows.withColumn("up", F.lag("d").over(w)).withColumn("down", F.lead("d").over(w))

    def shared(other):
        same = F.transform(F.sequence(F.lit(1), F.lit(MAX_DIGITS)), lambda i: F.substring("d", F.lit(1), i) == F.substring(F.col(other), F.lit(1), i))
        return F.when(F.col(other).isNotNull(), F.size(F.filter(same, lambda x: x))).otherwise(0)

    need = F.greatest(F.lit(digits), shared("up") + 1, shared("down") + 1)
    made = F.concat(F.lit("["), "category", F.lit("-"), F.substring(F.col("d"), F.lit(1), need), F.lit("]"))
    return near.select(F.coalesce("_old", made).alias("token"), "category", "value")


def append_dictionary(known: DataFrame, values: DataFrame, salt: str, digits: int = TOKEN_DIGITS) -> DataFrame:
    """The dictionary with the values it lacks; no token of it changes, and no token is given twice."""
    return token_dictionary(values, salt, digits, known)


def short_token(category: Column, value: Column, salt: str, digits: int = TOKEN_DIGITS) -> Column:
    """The token of a value that shares its first digits with no other one."""
    return F.concat(F.lit("["), category, F.lit("-"), F.substring(digest(category, value, salt), 1, digits), F.lit("]"))


def mask_columns(df: DataFrame, categories: dict[str, str], dictionary: DataFrame, salt: str, digits: int = TOKEN_DIGITS) -> DataFrame:
    """Values of the given columns replaced by their tokens; nulls and empty texts stay.

    ``dictionary`` has all values of the columns, made with the same salt and digits. A token follows from its value, so it is
    computed in the row; only values whose token is another one (it takes more digits, or was given before) are looked up,
    in a table that holds nothing else.
    """
    odd = materialise(dictionary.filter(F.col("token") != short_token(F.col("category"), F.col("value"), salt, digits)), "odd-tokens")
    few = odd.count() <= ODD_ROWS
    out = df
    for column, category in categories.items():
        pairs = odd.filter(F.col("category") == category).select(F.col("value").alias("_v"), F.col("token").alias("_t"))
        own = F.when(F.col(column) != "", short_token(F.lit(category), F.col(column), salt, digits)).otherwise(F.col(column))
        out = out.join(F.broadcast(pairs) if few else pairs, F.col(column) == F.col("_v"), "left").withColumn(column, F.coalesce("_t", own)).drop("_v", "_t")
    return out.select(*df.columns)


def column_values(df: DataFrame, categories: dict[str, str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(cat).alias("category"), F.col(c).alias("value")) for c, cat in categories.items()])
    return df.select(F.explode(cells).alias("c")).select("c.*").distinct()


OPEN, BREAK, CLOSE = "\u0001", "\u0002", "\u0003"


def marked_matches(text: Column, patterns: dict[str, str]) -> Column:
    """The text with every match as OPEN category BREAK value CLOSE; later patterns leave earlier matches alone."""
    for category, pattern in patterns.items():
        # a marked match is put back as it is, followed by an empty mark that is then taken away
        empty = f"{OPEN}{category}{BREAK}{CLOSE}"
        text = F.regexp_replace(text, f"({OPEN}[^{CLOSE}]*{CLOSE})|({pattern})", f"$1{OPEN}{category}{BREAK}$2{CLOSE}")
        text = F.replace(text, F.lit(empty), F.lit(""))
    return text


def find_patterns(texts: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, order_no, category, value) of all matches, each value once per text. Each pattern looks at what earlier ones left."""
    patterns = patterns or PATTERNS
    hits = F.regexp_extract_all(marked_matches(F.col(text), patterns), F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))
    order = F.create_map(*[F.lit(x) for no, c in enumerate(patterns) for x in (c, no)])
    parts = texts.select(key, F.explode(F.array_distinct(hits)).alias("m")).select(
        key, F.split_part("m", F.lit(BREAK), F.lit(1)).alias("category"), F.split_part("m", F.lit(BREAK), F.lit(2)).alias("value"))
    return parts.select(key, order[F.col("category")].alias("order_no"), "category", "value")


def replace_pairs(text: Column, pairs: Column) -> Column:
    """Every ``old`` replaced by its ``new``, in the order of the array."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["old"], p["new"]))


def mask_patterns(texts: DataFrame, key: str, text: str, dictionary: DataFrame, found: DataFrame | None = None,
                  patterns: dict[str, str] | None = None) -> DataFrame:
    """Texts with every match replaced by its token, match by match: equal digits that are no match stay."""
    patterns = patterns or PATTERNS
    found = find_patterns(texts, key, text, patterns) if found is None else found
    tokens = found.join(dictionary, ["category", "value"]).select(
        key, F.struct(F.concat("category", F.lit(BREAK), "value").alias("old"), F.col("token").alias("new")).alias("p"))
    per = tokens.groupBy(key).agg(F.map_from_entries(F.collect_set("p")).alias("_tokens"))
    # pieces between marks are text, pieces with a BREAK are matches
    pieces = F.split(marked_matches(F.col(text), patterns), f"[{OPEN}{CLOSE}]")
    put = F.transform(pieces, lambda s: F.when(F.contains(s, F.lit(BREAK)), F.coalesce(
        F.col("_tokens")[s], F.split_part(s, F.lit(BREAK), F.lit(2)))).otherwise(s))
    return (texts.join(per, key, "left")
            .withColumn(text, F.when(F.col("_tokens").isNotNull(), F.array_join(put, "")).otherwise(F.col(text))).drop("_tokens"))


def has_tokens(text: Column) -> Column:
    return F.coalesce(text.rlike(X.TOKEN), F.lit(False))


def tokens_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({X.TOKEN})"), F.lit(1)))


def detokenize(df: DataFrame, key: list[str], columns: list[str], dictionary: DataFrame) -> DataFrame:
    """Known tokens of the given columns replaced by their values, unknown ones kept; one join for all columns.

    Only rows with tokens take part in the join.
    """
    cells = F.array(*[F.col(c) for c in columns])
    marked = df.filter(F.exists(cells, has_tokens))
    asked = marked.select(*key, F.explode(F.array_distinct(F.flatten(F.transform(cells, lambda c: F.coalesce(
        tokens_in(c), F.expr("cast(array() as array<string>)")))))).alias("token"))
    pairs = (asked.join(dictionary.select("token", "value"), "token").groupBy(*key)
             .agg(F.collect_list(F.struct(F.col("token").alias("old"), F.col("value").alias("new"))).alias("_pairs")))
    out = df.join(pairs, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_pairs").isNotNull(), replace_pairs(F.col(c), F.col("_pairs"))).otherwise(F.col(c)))
    return out.drop("_pairs").select(*df.columns)


def restore_params(params: DataFrame, dictionary: DataFrame) -> dict:
    """Query parameters (name, value) with tokens made values, ready to be bound. The list of parameters is short."""
    return {r["name"]: r["value"] for r in detokenize(params, ["name"], ["value"], dictionary).collect()}
