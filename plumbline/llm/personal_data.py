"""Personal data: declared forms, and boosted trees over the spans that loose patterns propose.

The base forms are found as declared and always stay. Generators with high
recall propose further, overlapping spans; gradient-boosted trees score them
from their format and their context; thresholds calibrated on values kept apart
select those that are added. The declared forms are the labels: a span of a
form that has a check (card, address, phone, mail) is personal data if it
passes, and not if it fails. So that the trees judge what the generators
propose and not the declared forms again, every labelled span is also written
in the ways people write it around such patterns (``a (at) b (dot) c``, dots
in a card number, a phone without its country), in its place with its context,
and what the generators propose there is learned. Each kind of proposal has
its own threshold, set on such proposals of other values.

All labelled spans are learned from and calibrate: equal ones are counted in
the tasks, features by fixed intervals, so the trees get each kind of row once
with its weight, and thresholds come from running totals over the scores.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text, text_batches
from plumbline.operators.scans import Measures, segmented_scan
from plumbline.session import materialize

# The kinds in their order, and the pieces of the base forms.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("email_like", "ip_like", "card_like", "phone_like", "number_like")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]|[a-f]:[a-f]", re.I)

# The generators: kind and pattern of what they propose, besides every base form.
_LOOSE = (
    ("email_like", re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{1,63}){0,8}", re.I)),
    ("ip_like", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card_like", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9])")),
    ("phone_like", re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])")),
    ("number_like", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
)
_AT = re.compile(r"@|[(\[]at[)\]]", re.I)
_DOT = re.compile(r"\.|[(\[]dot[)\]]", re.I)
_WORDS = (
    re.compile(r"phone|tel|call|mobile|fax", re.I),
    re.compile(r"mail|contact|write to", re.I),
    re.compile(r"card|visa|master|pay|iban|account", re.I),
    re.compile(r"\bip\b|host|server|address", re.I),
    re.compile(r"order|invoice|ref|version|isbn|build|token|hash|id\b", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str):
    """Leftmost mail addresses: the characters before each @, back to the last match, and the domain behind it."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _addresses(text: str):
    """Leftmost groups of four numbers, with whether all are at most 255."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        place = run.start()
        for first in range(0, len(parts) - 3, 4):
            four = parts[first : first + 4]
            length = sum(map(len, four)) + 3
            yield place, place + length, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            place += length + 1


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind number, start, end) of the base findings, and of the matches that failed their check; code points."""
    good, bad = [], []
    if "@" in text:
        good += ((0, a, b) for a, b in _emails(text))
    if "." in text:
        for a, b, fits in _addresses(text):
            (good if fits else bad).append((1, a, b))
    for match in _DIGITS.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if len(digits) >= 12:
            (good if 16 <= len(digits) <= 19 and luhn(digits) else bad).append((2, match.start(), match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in match.group())
            (good if 8 <= n <= 15 else bad).append((3, match.start(), match.end()))
    return sorted(good), bad


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Every span a generator proposes; they may overlap."""
    return [(kind, m.start(), m.end()) for kind, pattern in _LOOSE for m in pattern.finditer(text)]


def fails(kind: str, span: str) -> bool:
    """Whether a proposal cannot be what its kind says: a check that needs no example."""
    if kind == "email_like":
        return not _DOT.search(_AT.split(span, maxsplit=1)[-1])
    if kind == "ip_like":
        return span.count(":") != 7
    digits = re.sub("[^0-9]", "", span)
    if kind == "card_like":
        return not luhn(digits)
    if kind == "phone_like":
        return False
    return digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000"


def rewritten(kind: int, span: str, good: bool) -> list[tuple[str, bool]]:
    """Other ways to write a base span (or one that failed its check), and whether each is personal data."""
    digits = re.sub("[^0-9]", "", span)
    forms: list[tuple[str, bool]] = []
    if len(span) > 128:
        return forms
    if kind == 0:
        local, _, host = span.partition("@")
        forms = [(f"{local} (at) {host.replace('.', ' (dot) ')}", True), (f"{local}[at]{host}", True), (f"{local} @ {host}", True)]
        forms += [(f"{local}{at}{host.split('.')[0]}", False) for at in ("@", " @ ", " (at) ")]
    elif kind == 1 and good:
        groups = [f"{int(part):x}" for part in span.split(".")]
        forms = [(":".join(["2001", "db8", "0", "0", *groups]), True), (":".join(groups), False)]
    elif kind == 2 and 13 <= len(digits) <= 19:
        blocks = [digits[:4], digits[4:8], digits[8:12], digits[12:]]
        forms = [(".".join(blocks), good), ("{}.{} {}-{}".format(*blocks), good)]
        if not good:  # numbers in groups that no phone has
            forms += [("-".join(blocks[:3]), False), (f"{digits[:2]}/{digits[2:5]}/{digits[5:8]}", False)]
    elif kind == 3 and good and len(digits) >= 10:
        area, middle, last = digits[-10:-7], digits[-7:-4], digits[-4:]
        forms = [(f"({area}) {middle}-{last}", True), (f"{area}.{middle}.{last}", True), (f"{area}-{middle}-{last}", True)]
    return forms


FEATURES = (
    "length digits letters separators kinds_of_separators groups longest_group shortest_group at host_dots dots colons brackets first_digit luhn largest_part "
    "before after phone_words mail_words card_words address_words other_words quoted line_start"
).split()


def _side(character: str) -> float:
    return 0.0 if not character else 1.0 if character.isspace() else 2.0 if character.isalpha() else 3.0 if character.isdigit() else 4.0


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of a span, in the order of FEATURES. A leading plus does not count."""
    span = text[start:end].lstrip("+")
    digits = [c for c in span if "0" <= c <= "9"]
    separators = [c for c in span if not c.isalnum()]
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", span) if g]
    numbers = [int(g) for g in groups if g.isascii() and g.isdigit() and len(g) < 10]
    before = text[max(0, start - 40) : start]
    return [
        float(len(span)), float(len(digits)), float(sum(c.isalpha() for c in span)), float(len(separators)),
        float(len(set(separators))), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(bool(_AT.search(span))), float(len(_DOT.findall("".join(_AT.split(span, maxsplit=1)[1:])))), float(span.count(".")),
        float(span.count(":")), float("(" in span), float(digits[0]) if digits else -1.0,
        float(len(digits) >= 12 and luhn("".join(digits))), float(max(numbers, default=0) if len(numbers) == len(groups) else -1),
        _side(text[start - 1 : start]), _side(text[end : end + 1]), *(float(bool(p.search(before))) for p in _WORDS),
        float(before[-1:] in ('"', "'", "=") and before != ""), float(start == 0 or text[start - 1] == "\n"),
    ]


class Taken:
    """Disjoint places of a text; overlapping ones given at the start are joined."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        place = bisect_right(self.ends, start)  # the first place that ends behind ``start``
        return place == len(self.starts) or self.starts[place] >= end

    def take(self, start: int, end: int) -> bool:
        """Take the span if it is free."""
        free = self.free(start, end)
        if free:
            place = bisect_right(self.starts, start)
            self.starts.insert(place, start)
            self.ends.insert(place, end)
        return free


# --- boosted trees ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosting:
    """Trees, their depth, and the precision asked for."""

    trees: int = 15
    depth: int = 4
    precision: float = 0.98


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees as arrays, and the least score that is selected (None: nothing is).

    ``by_kind`` holds the least score of kinds with proposals of their own to calibrate it; ``least`` is for others.
    """

    nodes: list = field(default_factory=list)
    weights: tuple = ()
    least: float | None = None
    by_kind: dict = field(default_factory=dict)

    def least_of(self, kind: str) -> float:
        least = self.by_kind.get(kind, self.least)
        return np.inf if least is None else least

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of personal data."""
        margin = np.zeros(len(rows))
        for (split, limit, left, right, value), weight in zip(self.nodes, self.weights):
            at = np.zeros(len(rows), np.int64)
            while (inner := split[at] >= 0).any():
                down = rows[np.arange(len(rows)), np.maximum(split[at], 0)] <= limit[at]
                at = np.where(inner, np.where(down, left[at], right[at]), at)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def _arrays(tree) -> tuple:
    """A fitted tree's nodes: split feature (-1 in leaves), limit, children, value."""
    rows: list[list] = []

    def add(node) -> int:
        place = len(rows)
        rows.append([-1, 0.0, 0, 0, float(node.prediction())])
        if hasattr(node, "leftChild") and node.subtreeDepth() > 0:
            split = node.split()
            rows[place][:2] = [int(split.featureIndex()), float(split.threshold())]
            rows[place][2] = add(node.leftChild())
            rows[place][3] = add(node.rightChild())
        return place

    add(tree._call_java("rootNode"))
    columns = list(zip(*rows))
    return tuple(np.array(c, np.float64 if k in (1, 4) else np.int64) for k, c in enumerate(columns))


CONTEXT = 64  # characters kept on both sides of a rewritten span; features look at 40


def examples(text: str):
    """(place, form, kind, label, value, features) of every span of a text that has a label.

    Form 0 is a declared form itself (kind empty), forms from 1 are the
    proposals in its rewritten versions, form -1 a proposal of the text whose
    kind has a check that decides. A proposal in a rewritten version is
    personal data if it is just the rewritten span and that is.
    """
    good, bad = base_spans(text)
    for label, spans in ((True, good), (False, bad)):
        for kind, a, b in spans:
            value = text[a:b]
            yield a, 0, "", label, value, features(text, a, b)
            left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
            for form, (other, personal) in enumerate(rewritten(kind, value, label), 1):
                window = left + other + right
                start, end = len(left), len(left) + len(other)
                for name, x, y in proposals(window):
                    if x < end and y > start:
                        right_one = personal and (x, y) == (start, end) and not fails(name, other)
                        yield a, form, name, right_one, value, features(window, x, y)
    taken = Taken((a, b) for _, a, b in good)
    for name, a, b in proposals(text):
        if taken.free(a, b):
            failed = fails(name, text[a:b])
            if failed or name in ("card_like", "ip_like"):
                yield a, -1, name, not failed, text[a:b], features(text, a, b)


#: Where trees may split a feature. The limits are fixed, so they depend on no sample and bound the different rows.
LIMITS = np.r_[np.arange(-0.5, 24), 27.5, 31.5, 39.5, 47.5, 63.5, 95.5, 127.5, 255.5, 511.5, 1023.5, 9999.5, 99999.5, 999999.5]

ROWS_A_TASK = 100_000  # different rows that a task of the fit has


def kept_apart(value: str) -> bool:
    """Whether a value only calibrates: a fifth does, by Spark's xxhash64 of its checksum."""
    digest = xxhash.xxh64_intdigest(zlib.crc32(value.encode("utf-8", "replace")).to_bytes(8, "little"), 42)
    return (digest - (digest >> 63 << 64)) % 5 == 0


def _labelled(batches):
    """Labelled spans as (apart, kind, label, interval of each feature) and how many there are of each."""
    for batch in text_batches(batches, chars=1_000_000):
        found = [x for text in batch.column("text").to_pylist() if _ANY.search(text) for x in examples(text)]
        if not found:
            continue
        _, _, kinds, labels, values, rows = zip(*found)
        intervals = np.searchsorted(LIMITS, np.array(rows)).astype(np.int8)
        equal = Counter(zip(map(kept_apart, values), kinds, map(float, labels), (x.tobytes() for x in intervals)))
        away, kind, label, own = zip(*equal)
        columns = [pa.array(away), pa.array(kind), pa.array(label), pa.array([list(x) for x in own], pa.list_(pa.int8())), pa.array(equal.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["apart", "kind", "label", "intervals", "n"])


def _scored(trees: Trees):
    """Calibration rows with their scores, by trees over intervals."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = trees.score(np.array(batch.column("intervals").to_pylist(), np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(scores), batch.column("n"), batch.column("positive")], ["kind", "score", "n", "positive"])

    return run


def _least(scored: DataFrame, precision: float) -> dict[str, float | None]:
    """The least score selected, by ``kind``: from the lowest one with the precision above it, half way to the next one below.

    ``scored`` has kind, score, n and positive. Scores between the two were never
    seen, so neither side owns them. None if no score has the precision; kinds
    without a positive one are left out.
    """
    sums = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    measures = Measures(running_sum={"above": "n", "right": "positive"})
    totals = segmented_scan(materialize(sums), ["kind"], [F.col("score").desc()], measures)
    last = totals.where(F.col("right") / F.col("above") >= precision).groupBy("kind").agg(F.min("score").alias("last"))
    below = F.max(F.when(F.col("score") < F.col("last"), F.col("score")))
    rows = totals.join(F.broadcast(last), "kind", "left").groupBy("kind").agg(F.sum("positive").alias("positive"), F.max("last").alias("last"), below.alias("below"))
    found = [r for r in rows.collect() if r.positive]  # one row for each kind
    return {r.kind: None if r.last is None else r.last if r.below is None else (r.last + r.below) / 2 for r in found}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", boosting: Boosting = Boosting()) -> Trees:
    """Fit trees to all labelled spans and their rewritten versions, and calibrate thresholds on values kept apart.

    A fifth of the values (by hash, so no copy of a value is on both sides) is
    never fitted; each kind's threshold is the lowest one with which the
    proposals of that kind among them have the precision asked for. A kind
    without a positive one among them takes the threshold of all spans; a kind
    that never reaches the precision selects nothing. Without spans of both
    labels nothing can be learned, and nothing is selected.
    """
    source = id_and_text(docs, id_col, text_col)
    counted = source.mapInArrow(_labelled, "apart boolean, kind string, label double, intervals array<tinyint>, n bigint")
    spans = materialize(counted.groupBy("apart", "kind", "label", "intervals").agg(F.sum("n").alias("n")))
    fit = materialize(spans.where("NOT apart").groupBy("label", "intervals").agg(F.sum("n").alias("n")))
    labels, rows = fit.agg(F.count_distinct("label"), F.count("*")).first()
    if labels < 2:
        return Trees()
    points = fit.coalesce(rows // ROWS_A_TASK + 1).sortWithinPartitions("intervals", "label")
    points = points.select("label", F.col("n").cast("double").alias("weight"), array_to_vector(F.col("intervals").cast("array<double>")).alias("features"))
    # Spark looks at the square of maxBins rows for the splits: at all of them with these.
    bins = max(len(LIMITS) + 1, min(int(rows**0.5) + 1, 46_340))
    model = GBTClassifier(maxIter=boosting.trees, maxDepth=boosting.depth, maxBins=bins, weightCol="weight", seed=7, cacheNodeIds=False).fit(points)
    by_interval = Trees([_arrays(t) for t in model.trees], tuple(model.treeWeights), None)
    nodes = [(split, np.where(split >= 0, LIMITS[np.floor(limit).astype(int)], 0.0), *rest) for split, limit, *rest in by_interval.nodes]
    apart = spans.where("apart").select("kind", "intervals", "n", (F.col("n") * F.col("label")).cast("bigint").alias("positive"))
    scored = apart.mapInArrow(_scored(by_interval), "kind string, score double, n bigint, positive bigint")
    least = _least(scored.withColumn("kind", F.explode(F.array("kind", F.lit("all")))), boosting.precision)
    return Trees(nodes, by_interval.weights, least.get("all"), {k: least[k] for k in ADDED if k in least})


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", boosting: Boosting = Boosting(), trees: Trees | None = None
) -> DataFrame:
    """doc_id and ``findings`` (kind, start, end in code points, score) of every row.

    Base findings come first, by kind as in KINDS, then start, with score 1.
    Added ones follow, by kind as in ADDED, then start: proposals that score at
    least the calibrated threshold of their kind, best first where they overlap, none that
    touches a base finding. Null and empty texts have none.
    """
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = source.sparkSession.sparkContext.broadcast(trees if trees is not None else train(docs, id_col, text_col, boosting))
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        for batch in text_batches(batches, chars=1_000_000):
            results, asked = [], []
            for number, text in enumerate(batch.column("text").to_pylist()):
                if not _ANY.search(text):
                    results.append([])
                    continue
                good, _ = base_spans(text)
                results.append([{"kind": KINDS[k], "start": a, "end": b, "score": 1.0} for k, a, b in good])
                if model.nodes:
                    taken = Taken((a, b) for _, a, b in good)
                    asked += ((number, k, a, b, features(text, a, b)) for k, a, b in proposals(text) if taken.free(a, b))
            if asked:
                scores = model.score(np.array([x[-1] for x in asked]))
                added: dict[int, list] = {}
                taken_by: dict[int, Taken] = {}
                for k in np.argsort(-scores, kind="stable"):
                    number, name, a, b, _ = asked[k]
                    if scores[k] < model.least_of(name):
                        continue
                    if taken_by.setdefault(number, Taken()).take(a, b):
                        added.setdefault(number, []).append({"kind": name, "start": a, "end": b, "score": float(scores[k])})
                for number, own in added.items():
                    results[number] += sorted(own, key=lambda x: (ADDED.index(x["kind"]), x["start"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(results, pa.list_(item))], ["doc_id", "findings"])

    return source.mapInArrow(run, f"doc_id {kind}, findings array<struct<kind:string,start:int,end:int,score:double>>")
