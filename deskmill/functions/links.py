"""Column functions on links and slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.functions import fixed as X
from deskmill.functions.text import strip
from deskmill.operators.ordered import running

TAIL = r"[.,;:!?)]+$"
SPAN = 1000  # numbers of a code that are worked on together


def _part(url: Column, group: int) -> Column:
    """1 scheme, 2 host part with port and user, 3 path."""
    return F.regexp_extract(url, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)", group)


def find_links(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per link: the link without trailing punctuation, and the text without it."""
    found = rows.select(*keep, F.regexp_extract_all(text, F.lit(f"({X.LINK})"), F.lit(1)).alias("_links"),
                        F.split(text, X.LINK, -1).alias("_parts"))
    each = found.select(*keep, "_links", "_parts", F.posexplode("_links").alias("_at", "_raw"))

    def others(i):
        return F.concat(F.when(i - 1 == F.col("_at"), F.lit("")).otherwise(F.element_at("_links", i)),
                        F.element_at("_parts", i + 1))

    rest = F.concat(F.element_at("_parts", 1), F.array_join(F.transform(F.sequence(F.lit(1), F.size("_links")), others), ""))
    return each.select(*keep, (F.col("_at") + 1).alias("link_no"), F.regexp_replace("_raw", TAIL, "").alias("link"),
                       strip(F.regexp_replace(rest, r"[ \t]{2,}", " ")).alias("rest"))


def publication_url(raw: Column) -> Column:
    """Address of the published base a link leads to; null for other addresses."""
    url = F.regexp_replace(raw, TAIL, "")
    scheme, host, path = F.lower(_part(url, 1)), _part(url, 2), _part(url, 3)
    user = F.regexp_extract(host, r"^(.*)@", 1)
    server = F.regexp_extract(host, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    service = F.transform(segments, lambda s: F.lower(s).isin(X.SERVICE_PARTS))
    stop = F.array_position(service, F.lit(True)).cast("int")
    segments = F.slice(segments, 1, F.when(stop > 0, stop - 1).otherwise(F.size(segments)))
    good = scheme.isin("http", "https") & (server != "") & ~user.rlike("[^:]") & (F.size(segments) > 0)
    return F.when(good, F.concat(scheme, F.lit("://"), host, F.lit("/"), F.array_join(segments, "/")))


def norm_url(url: Column) -> Column:
    """Scheme, host and path in lower case, without trailing slash, query and fragment."""
    u = strip(url)
    return F.lower(F.concat(_part(u, 1), F.lit("://"), _part(u, 2), F.regexp_replace(_part(u, 3), "/+$", "")))


def safe_url(url: Column) -> Column:
    """Without user and password."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1")


def transliterate(col: Column) -> Column:
    one = {k: v for k, v in X.TRANSLIT.items() if len(v) == 1}
    for letter, latin in X.TRANSLIT.items():
        if len(latin) != 1:
            col = F.replace(col, F.lit(letter), F.lit(latin))
    return F.translate(col, "".join(one), "".join(one.values()))


def slug(url: Column) -> Column:
    """Code made of the last path part: Latin letters, digits and underscores, 30 at most."""
    name = F.lower(F.substring_index(F.regexp_replace(_part(url, 3), "/+$", ""), "/", -1))
    code = F.regexp_replace(F.regexp_replace(transliterate(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    code = F.substring(code, 1, 30)
    code = F.when(code == "", "base").otherwise(code)
    return F.when(code.rlike("^[a-z]"), code).otherwise(F.concat(F.lit("b_"), code))


def unique_slugs(rows: DataFrame, code: str, order: str, segment: Column) -> DataFrame:
    """First bearer keeps the code, later ones get _2, _3 …; a number that is itself somebody's code is passed over.

    The i-th taken number t of a code lifts all ranks from t - i + 1 on by one more, so a row's number is its rank plus the
    number of the last such step at or before it: one ordered pass over ranks and steps, and no list of taken numbers.
    """
    numbered = running(rows.withColumn("_one", F.lit(1)), [code], [order], segment, sums={"_rank": F.col("_one")}).drop("_one")
    # a longer number than 18 digits is never reached by counting rows
    numbered_code = r"^(.*)_([1-9]\d{0,17})$"
    taken = (rows.select(F.regexp_extract(code, numbered_code, 1).alias("_root"),
                         F.regexp_extract(code, numbered_code, 2).try_cast("long").alias("_n")).filter("_n >= 2").distinct())
    # codes that nobody bears need no steps
    borne = taken.join(rows.select(F.col(code).alias("_root")).distinct(), "_root", "left_semi")
    counted = running(borne.withColumn("_one", F.lit(1)), ["_root"], ["_n"], F.floor(F.col("_n") / SPAN), sums={"_i": F.col("_one")})
    none = F.lit(None).cast("long")
    steps = counted.select("_root", (F.col("_n") - F.col("_i") + 1).alias("_rank"), F.col("_i").alias("_step"), F.lit(0).alias("_kind"),
                           F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    ranked = numbered.select(F.col(code).alias("_root"), F.col("_rank").cast("long").alias("_rank"), none.alias("_step"), F.lit(1).alias("_kind"),
                             F.struct(*rows.columns).alias("_row"))
    lifted = running(steps.unionByName(ranked), ["_root"], ["_rank", "_kind", "_step"], F.floor(F.col("_rank") / SPAN),
                     last={"_lift": F.col("_step")}).filter("_kind = 1")
    number = F.col("_rank") + F.coalesce("_lift", F.lit(0))
    return lifted.select("_row.*", F.when(F.col("_rank") == 1, F.col("_root")).otherwise(
        F.concat("_root", F.lit("_"), number.cast("string"))).alias("unique_code"))
