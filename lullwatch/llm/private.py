"""Personal data by bootstrapped contextual extraction: known identifiers teach lexical patterns, trusted patterns find identifiers of other forms.

Four patterns of the base kinds (e-mail, IP, card, phone) give the seeds. Everything else that looks like an identifier (seven or more digits with marks between them, addresses
written with "at" and "dot", hexadecimal addresses) is a candidate, with the kinds its form allows. Both are seen with the words around them: two before, two
behind, one on each side. Distinct pairs of a pattern (these words, digits as 0) and an instance (its value) form a graph over the whole corpus, which Spark scores in rounds:

* a pattern's confidence for a kind is the share of its instances known to be of that kind; instances of other kinds, or whose form excludes it, count against it,
  undecided ones by half. It is trusted from ``CONFIDENCE`` and ``SUPPORT`` known instances on.
* a candidate's score for a kind is one minus the product of what its trusted patterns leave open; from ``ACCEPT`` on it is known in the next round.

It ends when a round accepts nothing, after ``ROUNDS`` at the latest. Copies of a text add no evidence: values count once for a pattern. Every occurrence of an accepted value is
a found span. Texts are read once; only seeds, candidates and their words are kept, and only distinct pairs are shuffled. Trusted patterns and accepted
values are broadcast up to ``SMALL`` rows, beyond that they are joined by shuffles.

Defined results: a null or empty text has no spans; repeated rows are documents of their own; a null doc_id is kept; other columns are ignored; an empty table gives
an empty table; ties between kinds go to the first as listed. Found spans never overlap base spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.llm.common import register, stage, table, thrifty_map

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE, SUPPORT, ACCEPT, ROUNDS = 0.7, 4, 0.9, 4
SMALL = 200_000
NEAR = 80
"""Characters on each side that are looked at for words."""

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# a match can only start where a run of digits does, as none ends inside one
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBER = re.compile(r"(?<![0-9A-Za-z@])\+?\(?[0-9](?:[ .()/-]{0,2}[0-9]){6,}(?![0-9A-Za-z@])")
NAME = r"[A-Za-z0-9-]{1,63}"
AT, DOT = r"(?: ?[\[({<] ?(?:@|at) ?[\])}>] ?| ?@ ?)", r"(?: ?[\[({<] ?(?:\.|dot) ?[\])}>] ?| dot |\.)"
WRITTEN = re.compile(rf"{AT}{NAME}(?:{DOT}{NAME})+| at {NAME}(?: dot {NAME})+", re.IGNORECASE)
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")


def luhn(digits: str) -> bool:
    odd, even = map(int, digits[-1::-2]), map(int, digits[-2::-2])
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def emails(text: str):
    """Leftmost addresses, found from their ``@``: a local part is all allowed characters before it that no earlier match holds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of every base match that passes its test, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def forms(value: str) -> list[str]:
    """Kinds that a candidate's form allows."""
    digits = sum(c.isdigit() for c in value)
    if re.fullmatch(COLONS, value):
        return ["ip"]
    if "@" in value or re.search(r"[A-Za-z]", value):
        return ["email"]
    return [k for k, low, high in (("card", 12, 19), ("phone", 7, 15)) if low <= digits <= high]


def candidates(text: str, taken: list[tuple[str, int, int]]):
    """``start, end, forms`` of identifier-like strings outside ``taken``, from left to right; the first of overlapping ones counts."""
    found = [m.span() for m in NUMBER.finditer(text)]
    if ":" in text:
        found += [m.span() for m in COLONS.finditer(text)]
    for m in WRITTEN.finditer(text):
        start = m.start()
        while start and m.start() - start < 64 and not LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
    used = sorted((a, b) for _, a, b in taken)
    last, k = 0, 0
    for a, b in sorted(found):
        while k < len(used) and used[k][1] <= a:
            k += 1
        allowed = forms(text[a:b])
        if a >= last and allowed and not (k < len(used) and used[k][0] < b):
            yield a, b, allowed
            last = b


def plain_word(word: str) -> str:
    return "@" if "@" in word else re.sub("[0-9]", "0", word.lower())


def patterns(text: str, start: int, end: int) -> list[str]:
    """The words around a place: two before, two behind, one on each side. Digits and addresses in them are masked."""
    before, behind = text[max(0, start - NEAR):start], text[end:end + NEAR]
    left = ["^", "^", *map(plain_word, before.split())][-2:]
    right = [*map(plain_word, behind.split()), "$", "$"][:2]
    glue = "" if before[-1:].strip() else " ", "" if behind[:1].strip() else " "
    return [f"{left[0]} {left[1]}{glue[0]}_", f"_{glue[1]}{right[0]} {right[1]}", f"{left[1]}{glue[0]}_{glue[1]}{right[0]}"]


SEEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("forms", pa.list_(pa.string())), ("value", pa.int64()), ("patterns", pa.list_(pa.string()))]))
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, row, spans, seen``: a number of the row, its base spans, and all seeds and candidates with their values (hashed) and patterns."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def value(text: str) -> int:
        return xxhash.xxh64_intdigest(re.sub(r"[ .()/-]", "", text).lower()) - (1 << 63)

    def read(batches):
        from pyspark import TaskContext

        numbers = itertools.count(TaskContext.get().partitionId() << 40)
        for b in batches:
            spans, seen = [], []
            for t in b["text"]:
                t = t.as_py() or ""
                base = base_spans(t)
                spans.append([{"kind": k, "start": x, "end": y} for k, x, y in base])
                marks = [(x, y, k, [k]) for k, x, y in base] + [(x, y, None, f) for x, y, f in candidates(t, base)]
                seen.append([{"start": x, "end": y, "kind": k, "forms": f, "value": value(t[x:y]), "patterns": patterns(t, x, y)} for x, y, k, f in marks])
            rows = pa.array(list(itertools.islice(numbers, len(spans))), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], rows, pa.array(spans, SPANS), pa.array(seen, SEEN)], names=["doc_id", "row", "spans", "seen"])

    return docs.mapInArrow(thrifty_map(read), f"doc_id {kind}, row bigint, spans array<struct<kind: string, start: bigint, end: bigint>>, seen array<struct<start: bigint, "
                                              f"end: bigint, kind: string, forms: array<string>, value: bigint, patterns: array<string>>>")


def sized(df: DataFrame) -> DataFrame:
    """A written table, sent to every task if it is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def learn(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (``pattern, kind, confidence, support``) and accepted values (``value, kind, score``) of exploded ``seen`` rows."""
    pairs = stage(seen.select(F.explode("patterns").alias("pattern"), "value", "kind", "forms").distinct(), "private-pairs")
    known = pairs.limit(0).select("value", "kind", F.lit(1.0).alias("score"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    kinds = [(k, f"label = '{k}'", f"label is null and array_contains(forms, '{k}')") for k in KINDS]
    count, trusted = 0, None
    for _ in range(ROUNDS):
        labels = pairs.join(sized(known.withColumnRenamed("kind", "found")), "value", "left").withColumn("label", F.coalesce("kind", "found"))
        sums = labels.groupBy("pattern").agg(F.count("*").alias("n"), *(F.count_if(F.expr(e)).alias(f"{k}_{side}") for k, yes, open_ in kinds for side, e in (("yes", yes), ("open", open_))))
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_yes").alias("support"), F.col(f"{k}_open").alias("open")) for k in KINDS)))
        found = sums.select("pattern", "n", each.alias("k")).select("pattern", "k.kind", (F.col("k.support") / (F.col("n") - F.col("k.open") / 2)).alias("confidence"), "k.support")
        trusted = stage(found.where(f"support >= {SUPPORT} and confidence >= {CONFIDENCE}"), "private-patterns")
        asked = pairs.where("kind is null").select("pattern", "value", "forms").join(sized(trusted), "pattern").where("array_contains(forms, kind)")
        scores = asked.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.99)))))).alias("score")).where(f"score >= {ACCEPT}")
        known = scores.groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -order)).alias("k")).select("value", "k.kind", "k.score")
        known = stage(known, "private-values")
        was, count = count, known.count()
        if count == was:
            break
    return trusted, known


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, spans, found``: base spans and those the patterns add, each as an array of kind, start and end."""
    rows = stage(scan(docs), "private-rows")
    seen = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    _, known = learn(seen)
    hits = seen.where("kind is null").drop("kind").join(sized(known), "value").where("array_contains(forms, kind)")
    added = hits.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    return rows.drop("seen").join(added, "row", "left").select("doc_id", "spans", F.coalesce("found", F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint>>)")).alias("found"))


def written(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (KINDS.index(s["kind"]), s["start"])))


@register("op13_private_spans")
def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    kind = found.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for b in batches:
            base, added = b["spans"].to_pylist(), b["found"].to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            sums = pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base])
            yield pa.RecordBatch.from_arrays([b["doc_id"], *counts, sums, pa.array([written(x + y) for x, y in zip(base, added, strict=True)])],
                                             names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found.mapInArrow(thrifty_map(digest), f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
