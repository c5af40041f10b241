"""Secrets by declared forms and by character Markov models, in DataFrame functions only.

Two first-order Markov models over the characters of long tokens are counted
from labelled samples: values behind a secret's name or form are random
strings, all other long tokens are ordinary identifiers. A token whose
log-likelihood ratio says random is a finding too. Counts come from all rows;
only the two tables of character pairs, bounded by the alphabet, reach the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text
from plumbline.session import materialize

# The base forms, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
#: A run of the class is one match, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_CLASS = "[A-Za-z0-9+/_=-]"


@dataclass(frozen=True)
class Markov:
    """``shortest`` token that is judged or learned from; least log-likelihood ratio of a finding; counts added to each
    character; counts that a character's probability stands for in its pairs."""

    shortest: int = 16
    least_ratio: float = 10.0
    smoothing: float = 0.5
    backing: float = 30.0


#: Matches that are folded together. Arrays grow by copying, so long ones are made of short ones.
_CHUNK = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a column inside a function of array items is computed for every item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(items: Column) -> Column:
    """``items`` (an array that is not empty) in arrays of at most ``_CHUNK``."""
    last = F.floor((F.size(items) - 1) / _CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * _CHUNK + 1, _CHUNK))


def _spans(text: Column, matches: Column, pattern: str, good: Column | None = None) -> Column:
    """Start and end of every match (that is ``good``) in code points, from the lengths of the pieces between the matches.

    The text is split once and lengths are summed chunk by chunk, so the time
    is in proportion to the text for any number of matches that a text holds.
    """
    empty = F.array().cast("array<struct<start:int,end:int>>")
    pieces = F.slice(F.split(text, F.lit(pattern), -1), 1, F.size(matches))
    steps = F.zip_with(pieces, matches, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("length")))
    kept = good if good is not None else F.transform(matches, lambda m: F.lit(True))
    steps = F.zip_with(steps, kept, lambda s, g: F.struct(s["gap"].alias("gap"), s["length"].alias("length"), g.alias("good")))

    def step(done, x):
        start = done["at"] + x["gap"]
        end = start + x["length"]
        one = F.concat(done["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["good"], one).otherwise(done["spans"]).alias("spans"))

    def walk(chunk):
        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)

    def begins(walked):
        before = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
        return F.aggregate(
            walked,
            before,
            lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["list"], F.array(a["at"])).alias("list")),
            lambda a: a["list"],
        )

    def moved(walked, at):
        return F.transform(walked["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))

    def joined(walked):
        return F.flatten(F.zip_with(walked, begins(walked), moved))

    found = _let(steps, lambda s: _let(F.transform(_chunks(s), walk), joined))
    return F.when(F.size(matches) > 0, found).otherwise(empty)


def _apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that touch none of ``others``, both in order: each chunk meets only what lies between its ends."""

    def near(chunk):
        first, last = F.element_at(chunk, 1), F.element_at(chunk, -1)
        return F.filter(others, lambda o: (o["start"] < last["end"]) & (o["end"] > first["start"]))

    def free(chunk):
        return _let(near(chunk), lambda n: F.filter(chunk, lambda c: ~F.exists(n, lambda o: (o["start"] < c["end"]) & (o["end"] > c["start"]))))

    parted = _let(spans, lambda s: F.flatten(F.transform(_chunks(s), free)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), parted).otherwise(spans)


def _pairs(token: Column) -> Column:
    """The pairs of neighbouring characters, from one split of the token."""
    return _let(
        F.split(token, "(?!^)(?!$)"),
        lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b)),
    )


def _long_token(markov: Markov) -> str:
    return f"(?<!{_CLASS}){_CLASS}{{{markov.shortest},}}"


def _matched(source: DataFrame, markov: Markov) -> DataFrame:
    """doc_id, text and the matches of each pattern."""
    found = source
    for name, pattern, group in (("m_assign", ASSIGN, 0), ("values", ASSIGN, 2), ("m_access", ACCESS, 0), ("m_hex", HEX, 0), ("tokens", _long_token(markov), 0)):
        found = found.withColumn(name, F.regexp_extract_all("text", F.lit(pattern), group))
    return found


def _pair_counts(source: DataFrame, markov: Markov) -> DataFrame:
    """random (boolean), pair, n: the pairs of neighbouring characters in different labelled tokens.

    A token is a sample of random strings if a base form has it as its value,
    else of identifiers, unless it contains such a value of its text or lies
    in one. Both have ``shortest`` characters or more, so they share the first
    so many of the shorter, and meet in a join by these.
    """
    values = F.filter("values", lambda v: F.char_length(v) >= markov.shortest)
    kinds = {"value": F.array_distinct(F.concat(values, "m_access", "m_hex")), "token": F.array_distinct("tokens")}
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("strings")) for k, v in kinds.items()])
    numbered = _matched(source, markov).withColumn("row", F.monotonically_increasing_id())
    found = numbered.select("row", F.explode(listed).alias("s"))
    strings = materialize(found.select("row", "s.kind", F.explode("s.strings").alias("string")))
    value = strings.where("kind = 'value'").select("row", F.col("string").alias("value"))
    # A token with a base form of its own contains a value; the others are looked up.
    token = strings.where((F.col("kind") == "token") & ~F.col("string").rlike(HEX) & ~F.col("string").rlike(ACCESS))
    token = token.select("row", F.col("string").alias("token"))

    def grams(column):
        places = F.sequence(F.lit(0), F.char_length(column) - markov.shortest)
        return F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(column, i + 1, F.lit(markov.shortest))))).alias("gram")

    def head(column):
        return F.substring(column, 1, markov.shortest).alias("gram")

    rows_with_both = value.select("row").distinct()
    asked = token.join(rows_with_both, "row", "left_semi")
    inside = asked.select("row", "token", grams("token")).join(value.select("row", "value", head("value")), ["row", "gram"]).where(F.contains("token", "value"))
    around = asked.select("row", "token", head("token")).join(value.select("row", "value", grams("value")), ["row", "gram"]).where(F.contains("value", "token"))
    named = inside.select("row", "token").union(around.select("row", "token")).distinct()
    plain = token.join(named, ["row", "token"], "left_anti")
    both = value.select(F.lit(True).alias("random"), F.col("value").alias("token")).union(plain.select(F.lit(False), "token"))
    return both.distinct().select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))


def ratio_table(counts: Mapping[tuple[bool, str], int], markov: Markov) -> list[float]:
    """Log-likelihood ratio of every pair of ASCII characters, at 128 * first + second; 0 outside the alphabet.

    A pair's probability is backed by that of its second character, which is
    backed by the uniform one; without samples of a class its model is uniform.
    A token that is judged was itself counted as an identifier, so one count is
    taken out of each identifier pair.
    """
    counts = {(k, pair): n if k else n - 1 for (k, pair), n in counts.items()}
    ratios = [0.0] * (128 * 128)
    single = {}
    for k in (True, False):
        n = {second: sum(counts.get((k, first + second), 0) for first in ALPHABET) for second in ALPHABET}
        whole = sum(n.values()) + markov.smoothing * len(ALPHABET)
        single[k] = {c: (n[c] + markov.smoothing) / whole for c in ALPHABET}
    for first in ALPHABET:
        seen = {k: sum(counts.get((k, first + second), 0) for second in ALPHABET) for k in (True, False)}
        for second in ALPHABET:
            odds = [(counts.get((k, first + second), 0) + markov.backing * single[k][second]) / (seen[k] + markov.backing) for k in (True, False)]
            ratios[128 * ord(first) + ord(second)] = math.log(odds[0] / odds[1])
    return ratios


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", markov: Markov = Markov()) -> list[float]:
    """The ratio table of the tokens of all texts."""
    rows = _pair_counts(id_and_text(docs, id_col, text_col), markov).collect()  # at most 2 * 67 * 67 rows
    return ratio_table({(r.random, r.pair): r.n for r in rows}, markov)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", markov: Markov = Markov(), ratios: list[float] | None = None
) -> DataFrame:
    """doc_id and ``findings`` (kind, start, end in code points) of every row, by start, then kind as in KINDS.

    Base kinds are all there; a ``random`` token is left out where it touches a
    base finding. Null and empty texts have none. ``ratios`` is a trained table
    (default: trained on ``docs``).
    """
    source = id_and_text(docs, id_col, text_col)
    table = F.from_json(F.lit(json.dumps(ratios if ratios is not None else train(docs, id_col, text_col, markov))), "array<double>")
    found = _matched(source, markov)
    long_enough = F.transform("values", lambda v: F.char_length(v) >= ASSIGN_VALUE)
    found = (
        found.withColumn("assign", _spans(F.col("text"), F.col("m_assign"), ASSIGN, long_enough))
        .withColumn("access", _spans(F.col("text"), F.col("m_access"), ACCESS))
        .withColumn("hex", _spans(F.col("text"), F.col("m_hex"), HEX))
    )

    def random_like(token: Column) -> Column:
        # A token holds every hexadecimal run and access key that it touches, so these are seen in the token itself.
        ratio = F.aggregate(_pairs(token), F.lit(0.0), lambda total, pair: total + F.get(table, F.ascii(pair) * 128 + F.ascii(F.substring(pair, 2, 1))))
        return ~token.rlike(HEX) & ~token.rlike(ACCESS) & (ratio >= markov.least_ratio)

    judged = found.withColumn("random", _spans(F.col("text"), F.col("tokens"), _long_token(markov), F.transform("tokens", random_like)))
    judged = judged.withColumn("random", _apart(F.col("random"), F.col("assign")))

    def numbered(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))

    listed = [numbered(n, kind) for n, kind in enumerate(KINDS)]
    names = F.array(*map(F.lit, KINDS))
    return judged.select(
        "doc_id",
        F.transform(
            F.array_sort(F.concat(*listed)),
            lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        ).alias("findings"),
    )


def as_text(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
