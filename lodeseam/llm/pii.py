"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

DataFrame functions only. A text is cut by the pattern (the gaps) and the matches are extracted; running
lengths of gaps and matches give code-point offsets. The patterns are possessive and anchored at the start
of a run (or the end of the previous match), so they are linear in the text and need no deep recursion, and
they match exactly where the plain leftmost pattern would. Account numbers are proposed at every head and end
by their country's length, since capitals that follow them read like more of the number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.base import whole_text

CONTEXT_CHARS = 48


@dataclass(frozen=True)
class Kind:
    """One kind of span: its pattern, a cheap test that texts without any fail, and its scoring."""

    name: str
    pattern: str
    hint: str
    score: float
    words: str
    base: bool = True
    group: int = 0


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|host|server|adresse"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++", r"[0-9][0-9 -]{12}", 0.8, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z0-9]{4}", r"[A-Z]{2}[0-9]{2}", 0.9, "iban|bank|account|konto|compte|cuenta", base=False, group=1),
)

#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    digit = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, F.floor(digit(i) / 5).cast("int") + (digit(i) * 2) % 10).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (capitals and digits) leaves 1 modulo 97, country and check digits last."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The checksum or range test of one proposed span."""
    n = F.length(digits_of(match))
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _spans(kind: Kind, order: int, text: Column, matches: Column, gaps: Column) -> Column:
    """array<struct(start, order, end, kind, score)> of the confirmed matches."""
    near = lambda i: F.concat(F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS)))
    item = lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"), confirmed(kind.name, m).alias("ok"), near(i).rlike(f"(?i){kind.words}").alias("near"))
    span = lambda acc, x: F.struct(
        (acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("order"), (acc["at"] + x["gap"] + x["n"]).alias("end"), F.lit(kind.name).alias("kind"),
        F.when(x["near"], F.lit(min(1.0, kind.score + 0.1))).otherwise(F.lit(kind.score)).alias("score"),
    )
    empty = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string,score:double>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.when(x["ok"], F.concat(acc["spans"], F.array(span(acc, x)))).otherwise(acc["spans"]).alias("spans"))
    return F.when(F.size(matches) > 0, F.aggregate(F.transform(matches, item), start, step, lambda acc: acc["spans"])).otherwise(empty)


def account_length(run: Column) -> Column:
    """How many characters at the start of `run` are an account number, 0 if none.

    An account ends where a word of the run ends, has 15 to 34 characters and passes mod-97. The country's
    length comes first, then the whole run, then for a country without a known length any, the longest first.
    """
    plain = lambda p: F.replace(p, F.lit(" "), F.lit(""))
    known = F.coalesce(*[F.when(F.left(run, F.lit(2)).isin(names.split()), F.lit(n)) for n, names in IBAN_LENGTHS.items()], F.lit(0))
    words = F.split(run, " ")
    starts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    shaped = F.filter(starts, lambda p: plain(p).rlike("^[A-Z0-9]{15,34}$"))
    good = lambda p, i: ((known == F.length(plain(p))) | (known == 0) | (i == 0)) & mod97(plain(p))
    fits = F.filter(shaped, good)
    exact = F.filter(fits, lambda p: F.length(plain(p)) == known)
    return F.coalesce(F.length(F.get(exact, F.lit(0))), F.length(F.get(fits, F.lit(0))), F.lit(0))


def _account_spans(kind: Kind, order: int, text: Column, runs: Column, gaps: Column) -> Column:
    """Like _spans() for runs that start at every possible head of an account; heads inside an account do not count.

    A match is only the head's four characters, so what follows an account is proposed on its own.
    """
    near = lambda a, s, e: F.concat(
        F.right(F.substring(text, a + 1, s - a), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.get(F.split(F.substring(text, e + 1, F.lit(2 * CONTEXT_CHARS)), kind.pattern, 2), F.lit(0)), F.lit(CONTEXT_CHARS))
    ).rlike(f"(?i){kind.words}")
    score = lambda a, s, e: F.when(near(a, s, e), F.lit(min(1.0, kind.score + 0.1))).otherwise(F.lit(kind.score))
    empty = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string,score:double>>)")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        s, e = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["n"]
        span = F.struct(s.alias("start"), F.lit(order).alias("order"), e.alias("end"), F.lit(kind.name).alias("kind"), score(acc["end"], s, e).alias("score"))
        ok = (x["n"] > 0) & (s >= acc["end"])
        return F.struct((s + 4).alias("at"), F.when(ok, e).otherwise(acc["end"]).alias("end"), F.when(ok, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    items = F.transform(runs, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), account_length(m).alias("n")))
    return F.when(F.size(runs) > 0, F.aggregate(items, start, step, lambda acc: acc["spans"])).otherwise(empty)


def find_pii(df: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """`df` with the column `_pii`: array<struct(start, order, end, kind, score)>, by start, then kind.

    Offsets count code points, the end exclusive. A null or empty text has no spans. Overlapping spans of
    different kinds all stay. Each row is handled alone: nothing is shuffled, and copies cost what they weigh.
    """
    text = whole_text(text_col)
    out = df.select("*", text.alias("_pii_text"))
    for k in kinds:
        hit = F.col("_pii_text").contains(k.hint) if k.hint == "@" else F.col("_pii_text").rlike(k.hint)
        none = F.expr("cast(array() as array<string>)")
        out = out.withColumn(f"_pii_m_{k.name}", F.when(hit, F.regexp_extract_all("_pii_text", F.lit(k.pattern), F.lit(k.group))).otherwise(none))
        out = out.withColumn(f"_pii_g_{k.name}", F.when(F.size(f"_pii_m_{k.name}") > 0, F.split("_pii_text", k.pattern, -1)).otherwise(none))
    found = [(_account_spans if k.group else _spans)(k, i, F.col("_pii_text"), F.col(f"_pii_m_{k.name}"), F.col(f"_pii_g_{k.name}")) for i, k in enumerate(kinds)]
    out = out.withColumn("_pii", F.array_sort(F.concat(*found)))
    return out.drop("_pii_text", *[f"_pii_{x}_{k.name}" for k in kinds for x in "mg"])


def masked(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        added = F.struct(x["end"].alias("at"), F.concat(acc["parts"], F.array(kept, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))).alias("parts"))
        return F.when(x["start"] >= acc["at"], added).otherwise(acc)

    last = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, last)).otherwise(text)


def digest(df: DataFrame, id_col: str = "doc_id", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts, the hash of the base spans and the list of all spans of every row of find_pii()'s output."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k.name for k in kinds if k.base]
    count = lambda name: F.size(F.filter("_pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [count(name) for name in base]
    return df.select(
        id_col, *counts, F.sha2(listed(F.filter("_pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("_pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("_pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
