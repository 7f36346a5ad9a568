"""Personal data: patterns propose, checksums confirm, context adjusts.  DataFrame functions only.

Each kind has a Java regular expression, a validator over the matched text (Luhn, mod 97, digit counts, octets)
and words that raise its score when they stand shortly before a match.  A span counts from ``THRESHOLD`` on.
The base kinds reach it with their validator alone, and so do IBANs, whose checksum is theirs; keys with a known prefix,
signed tokens and private keys reach it by their shape; social security numbers and other secrets (long hexadecimal or
mixed strings) need a context word besides.  Context words count within ``CONTEXT`` characters before or after a match, as
far as the next match of its kind; matches that follow each other closely share their context.

Spans come from the pieces between the matches: ``split`` gives the gaps, ``regexp_extract_all`` the matches,
and running sums of their lengths the positions, in chunks so that a text with very many matches stays linear.
All patterns scan in linear time: runs are possessive and begin where no character of the run precedes, or
where the last match ended (``\\G``), which is where a leftmost search would begin as well.

Defined cases: a null text is an empty one and has no spans; no pattern or row limit applies to long texts;
repeated rows give repeated results; an empty table gives no rows; an input column named ``pii`` (of ``mask`` also
``masked``) is replaced, all others pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import source_table

THRESHOLD = 0.5
CONTEXT = 40  # characters on either side of a match in which a context word counts
SERIES = 8  # a match so near to the one before it shares its context
CHUNK = 256
SPANS = "array<struct<start:long,rank:int,kind:string,end:long,score:double>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("."), F.lit(0))


def between(match: Column, least: int, most: int) -> Column:
    return F.length(digits(match)).between(least, most)


def luhn(match: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    each = F.reverse(characters(digits(match)))
    value = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.when(between(match, 12, 19), F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0).otherwise(False)


def mod97(match: Column) -> Column:
    """An IBAN's remainder: its first four characters go last, letters count from 10."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(characters(turned), F.lit(0), step) == 1


def octets(match: Column) -> Column:
    """Four numbers of at most 255, leading zeros allowed."""
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    shape: float  # score of a proposal
    check: float  # added by its validator; a failed one drops the match
    context: float  # added by a context word
    words: str


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", lambda m: F.lit(True), 0.6, 0.2, 0.2, "mail|contact|write|courriel|correo|schreib"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.4, 0.3, 0.3, r"\bip\b|host|server|address|adresse|direcci"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", luhn, 0.2, 0.5, 0.3, "card|visa|credit|karte|carte|tarjeta|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: between(m, 9, 15), 0.3, 0.4, 0.3, "phone|tel|call|mobil|fax|anruf|appel|llam"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", mod97, 0.2, 0.5, 0.3, "iban|konto|account|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.1, 0.2, 0.4, "ssn|social security|taxpayer"),
    Kind("secret", r"(?<![A-Za-z0-9+/=_-])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?=[A-Za-z0-9+/_-]{0,80}[0-9])(?=[A-Za-z0-9+/_-]{0,80}[A-Z])(?=[A-Za-z0-9+/_-]{0,80}[a-z])[A-Za-z0-9+/_-]{20,80}={0,2})(?![A-Za-z0-9+/=_-])", lambda m: F.lit(True), 0.1, 0.2, 0.4, "token|secret|password|passwd|api.?key|credential"),
    Kind("key", r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])", lambda m: F.lit(True), 0.4, 0.3, 0.3, "token|secret|api.?key|credential|access"),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", lambda m: F.lit(True), 0.5, 0.2, 0.3, "token|bearer|authorization|jwt"),
    Kind("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END (?:[A-Z]+ )?PRIVATE KEY-----", lambda m: F.lit(True), 0.7, 0.2, 0.1, "key"),
)
BASE_KINDS = tuple(k.name for k in KINDS[:4])


def find(docs: DataFrame) -> DataFrame:
    """docs with ``pii``: the spans of all kinds (start and end in code points, rank of the kind, score), ordered."""
    n = range(len(KINDS))
    names = [c for c in docs.columns if c != "pii"]
    rows = docs.select(F.struct(*names).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"m{i}") for i, k in enumerate(KINDS)])
    rows = rows.select("*", *[F.when(F.size(f"m{i}") > 0, F.split("text", k.pattern, -1)).alias(f"g{i}") for i, k in enumerate(KINDS)])
    zipped = [F.when(F.size(f"m{i}") > 0, F.transform(f"m{i}", _proposal(k, F.col(f"g{i}")))).alias(f"z{i}") for i, k in enumerate(KINDS)]
    rows = rows.select("row", *zipped)
    rows = rows.select("row", *[_chunks(F.col(f"z{i}")).alias(f"c{i}") for i in n])
    rows = rows.select("row", *[f"c{i}" for i in n], *[_starts(F.col(f"c{i}")).alias(f"s{i}") for i in n])
    rows = rows.select("row", *[F.when(F.col(f"c{i}").isNotNull(), _spans(F.col(f"c{i}"), F.col(f"s{i}"), i, k.name)).alias(f"p{i}") for i, k in enumerate(KINDS)])
    none = F.array().cast(SPANS)
    return rows.select("row", F.array_sort(F.concat(*[F.coalesce(F.col(f"p{i}").cast(SPANS), none) for i in n])).alias("pii")).select("row.*", "pii")


def _proposal(kind: Kind, gaps: Column) -> Callable[[Column, Column], Column]:
    """A match's gap, size and score; gaps are the pieces around the matches, one more than there are matches."""

    def make(match: Column, i: Column) -> Column:
        gap, rest = F.get(gaps, i), F.get(gaps, i + 1)
        near = F.lower(F.right(gap, F.lit(CONTEXT))).rlike(kind.words) | F.lower(F.left(rest, F.lit(CONTEXT))).rlike(kind.words)
        before = F.lower(F.right(F.get(gaps, i - 1), F.lit(CONTEXT))).rlike(kind.words) & (F.length(gap) < SERIES)
        score = F.lit(kind.shape + kind.check) + F.when(near | F.coalesce(before, F.lit(False)), kind.context).otherwise(0.0)
        return F.struct(F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("size"), F.when(kind.valid(match), F.round(score, 2)).otherwise(0.0).alias("score"))

    return make


def _chunks(proposals: Column) -> Column:
    """Chunks of proposals and the characters each takes."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(proposals) - 1) / CHUNK).cast("int"))
    chunk = F.transform(numbers, lambda c: F.slice(proposals, c * CHUNK + 1, F.lit(CHUNK)))
    return F.transform(chunk, lambda x: F.struct(x.alias("rows"), F.aggregate(x, F.lit(0).cast("long"), lambda a, p: a + p["gap"] + p["size"]).alias("size")))


def _starts(chunks: Column) -> Column:
    """Where each chunk begins."""
    first = F.array(F.lit(0).cast("long"))
    return F.aggregate(chunks, first, lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c["size"])))


def _spans(chunks: Column, starts: Column, rank: int, kind: str) -> Column:
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start, end = acc["at"] + p["gap"], acc["at"] + p["gap"] + p["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), p["score"].alias("score"))
        return F.struct(end.alias("at"), F.when(p["score"] >= THRESHOLD, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.flatten(F.transform(chunks, lambda c, i: F.aggregate(c["rows"], begin(F.element_at(starts, i + 1)), step)["out"]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame) -> DataFrame:
    """``find`` with ``masked``: the text with each span replaced by its kind in brackets; of overlapping spans the first."""
    rows = find(docs.drop("masked"))
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda a, s: F.substring(text, (a + 1).cast("int"), (s - a).cast("int"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(piece(a["at"], s["start"]), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out")))
    done = rows.select(F.struct("*").alias("row"), F.aggregate("pii", start, step).alias("done"))
    text = F.coalesce("row.text", F.lit(""))
    masked = F.concat(F.array_join("done.out", ""), F.substring(text, (F.col("done.at") + 1).cast("int"), F.length(text)))
    return done.select("row", masked.alias("masked")).select("row.*", "masked")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(source_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    return rows.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))
