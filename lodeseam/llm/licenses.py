"""License scans: exact set-similarity search of license templates in the blocks of every text.

Template words are ordered by how many documents of the corpus hold them, rarest first. A block can hold
the required share of a template only if it holds one of the template's first words in that order (prefix
filter), has enough words (length filter) and enough of them after the first one in common (positional
filter); blocks that pass are counted exactly. The templates are a fixed, small parameter, so they travel
with the plan as literals and no document is shuffled; only word counts of the template words are gathered.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.base import whole_text

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What ends a sentence; single letters and these abbreviations end none.
SENTENCES = r"(?<=[.!?;])(?<!\b[A-Za-z]\.)(?<!\b[Vv]er\.)(?<!\b[Vv]ers\.)(?<!\b[Nn]o\.)(?<!\b[Ii]nc\.)(?<!\b[Ll]td\.)(?<!\b[Cc]orp\.)(?<!\b[Ll]ic\.)\s+"
BLOCKS = r"\n+|" + SENTENCES
WRAPPED = r"\n[ \t\x0B\f\r]*\n\s*|" + SENTENCES
CONTAINMENT = 0.8
#: Base phrases and labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices by which works name their license, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-text",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under the creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A template's distinct words, rarest first, and how many of them a block needs."""

    label: str
    words: tuple[str, ...]
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def template_order(df: DataFrame, text_col: str, templates: dict[str, str]) -> list[str]:
    """All template words, by the number of texts that hold them, then by code point."""
    vocabulary = sorted({w for t in templates for w in t.split()})
    held = F.array_intersect(F.split(F.lower(whole_text(text_col)), SEPARATORS), F.array(*map(F.lit, vocabulary)))
    counts = {r[0]: r[1] for r in df.select(F.explode(held).alias("w")).groupBy("w").count().collect()}  # at most the templates' words
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def ordered_templates(order: list[str], templates: dict[str, str], containment: float) -> list[Template]:
    rank = {w: i for i, w in enumerate(order)}
    sets = [(label, tuple(sorted(set(t.split()), key=rank.__getitem__))) for t, label in templates.items()]
    return [Template(label, words, math.ceil(containment * len(words) - 1e-9)) for label, words in sets]


def _matches(block: Column, order: list[str], templates: list[Template]) -> Column:
    """array<struct(label, containment)> of the templates that `block` holds to the threshold."""
    words = F.array_distinct(F.split(F.translate(block, ASCII_UPPER, ASCII_LOWER), SEPARATORS))
    state = F.array(F.struct(words.alias("all"), F.array_intersect(F.array(*map(F.lit, order)), words).alias("known")))

    def of(t: Template, b: Column) -> Column:
        own, prefix = F.array(*map(F.lit, t.words)), F.array(*map(F.lit, t.prefix))
        first = F.get(F.array_intersect(prefix, b["known"]), F.lit(0))
        rest = F.least(F.lit(len(t.words)) - F.array_position(own, first), F.size(b["known"]) - F.array_position(b["known"], first))
        common = F.size(F.array_intersect(own, b["known"]))
        may = first.isNotNull() & (F.size(b["all"]) >= t.need) & (rest + 1 >= t.need)
        return F.when(F.coalesce(may, F.lit(False)), F.when(common >= t.need, F.struct(F.lit(t.label).alias("label"), (common / F.lit(len(t.words))).alias("containment"))))

    each = F.transform(state, lambda b: F.array(*[of(t, b) for t in templates]))
    return F.filter(F.flatten(each), lambda x: x.isNotNull())


def _around_breaks(sentence: Column, n: int) -> Column:
    """The `n` words before and after each line break of `sentence`, joined by spaces."""
    lines = F.filter(F.split(sentence, "\n"), lambda line: line.rlike(WORD))
    words = lambda part: F.filter(F.split(F.array_join(part, " "), SEPARATORS), lambda w: w != "")

    def window(k: Column) -> Column:
        before, after = words(F.slice(lines, F.greatest(F.lit(1), k - n + 1), F.least(k, F.lit(n)))), words(F.slice(lines, k + 1, F.lit(n)))
        return F.array_join(F.concat(F.slice(before, F.greatest(F.lit(1), F.size(before) - n + 1), F.lit(n)), F.slice(after, 1, n)), " ")

    none = F.expr("cast(array() as array<string>)")
    return F.when(F.size(lines) > 1, F.transform(F.sequence(F.lit(1), F.size(lines) - 1), window)).otherwise(none)


def scan_licenses(df: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """`df` with `_licenses`: array<struct(label, containment)>, one per block and template that meet.

    A block is a line or a sentence of it, or, for wrapped notices, what stands around a line break inside a
    sentence of a paragraph: as many words as the template has on either side. Words are runs of letters, digits and non-ASCII characters with
    A-Z lower-cased. A null or empty text holds nothing. Word counts cover all texts of `df`, whole.
    """
    if not 0 < containment <= 1:
        raise ValueError("containment must be in (0, 1]")
    order = template_order(df, text_col, templates)
    ready = ordered_templates(order, templates, containment)
    prefixes = "|".join(re.escape(w) for w in sorted({w for t in ready for w in t.prefix}))
    edge = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pattern = f"(?i)(?<!{edge})(?:{prefixes})(?!{edge})"
    text = whole_text(text_col)
    blocks = F.when(text.rlike(pattern), F.filter(F.split(text, BLOCKS), lambda b: b.rlike(pattern)))
    found = F.flatten(F.transform("_license_blocks", lambda b: _matches(b, order, ready)))
    none = F.expr("cast(array() as array<struct<label:string,containment:double>>)")
    wrapped = F.when(text.rlike(pattern), F.filter(F.split(text, WRAPPED), lambda b: b.contains("\n") & b.rlike(pattern)))
    lengths = {label: len(t.split()) for t, label in templates.items()}
    around = lambda t: F.flatten(F.transform(F.flatten(F.transform("_license_wrapped", lambda b: _around_breaks(b, lengths[t.label]))), lambda b: _matches(b, order, [t])))
    more = F.when(F.size("_license_wrapped") > 0, F.concat(*[around(t) for t in ready])).otherwise(none)
    out = df.withColumn("_license_blocks", blocks).withColumn("_license_wrapped", wrapped)
    return out.withColumn("_licenses", F.concat(F.when(F.size("_license_blocks") > 0, found).otherwise(none), more)).drop("_license_blocks", "_license_wrapped")


def phrase_places(df: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """`df` with `_n_words` and `_phrases`: array<struct(label, places, first, last)> of phrases that occur.

    Places are word positions from 0. A phrase must not be able to overlap itself.
    """
    text = whole_text(text_col)
    count = F.regexp_count(text, F.lit(WORD)).cast("long")
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    ends = "|".join(sorted({p.split()[-1] for p in phrases}))
    plain = F.when(text.rlike(f"(?i){ends}"), F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" ")))
    out = df.select("*", count.alias("_n_words"), plain.alias("_plain"))

    def of(phrase: str, label: str) -> Column:
        cut = F.array(F.split("_plain", f"(?i) {phrase}(?= )", -1))
        n = len(phrase.split())
        place = lambda p: F.struct(
            F.lit(label).alias("label"), (F.size(p) - 1).cast("long").alias("places"), spaces(F.get(p, F.lit(0))).cast("long").alias("first"),
            (F.col("_n_words") - spaces(F.element_at(p, -1)) + 1 - n).cast("long").alias("last"),
        )
        return F.get(F.transform(cut, place), F.lit(0))

    found = F.filter(F.array(*[of(p, label) for p, label in phrases.items()]), lambda x: x["places"] > 0)
    none = F.expr("cast(array() as array<struct<label:string,places:bigint,first:bigint,last:bigint>>)")
    return out.withColumn("_phrases", F.when(F.col("_plain").isNotNull(), found).otherwise(none)).drop("_plain")


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of scan_licenses(phrase_places()): counts, places, labels and the best containment."""
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base, own = F.transform("_phrases", lambda p: p["label"]), F.transform("_licenses", lambda p: p["label"])
    return df.select(
        id_col, F.col("_n_words").alias("n_words"), F.aggregate("_phrases", F.lit(0).cast("long"), lambda a, p: a + p["places"]).alias("n_base"),
        F.array_min(F.transform("_phrases", lambda p: p["first"])).alias("first_word"), F.array_max(F.transform("_phrases", lambda p: p["last"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("_licenses", lambda p: p["containment"])), F.lit(0.0)).alias("score"),
    )
