"""Personal data in texts, by column expressions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, digit counts for
phones, ranges for addresses) and words near a span adjust its score. A span is kept where its score reaches
``THRESHOLD``. The four base kinds start at the threshold once their validator has passed, so context can raise
but never drop them; the added kinds need a stricter pattern or context to get there.

Offsets count code points, ends are exclusive. A pattern's matches are leftmost and do not overlap. Positions
come from the pieces between matches: ``split`` and ``regexp_extract_all`` walk a text in the same way, so the
n-th match starts where the first n pieces and n - 1 matches end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, make_room, table

THRESHOLD = 0.5
#: Characters on each side of a span in which context words count, and what one adds or takes.
REACH, BOOST, PENALTY = 40, 0.35, 0.2
#: Matches whose positions are added up in one inner step.
STEP = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's checksum."""
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(back)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
            F.substring(F.lit("0246813579"), F.substring(back, i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int")
        ),
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1 in ISO 7064 mod 97-10, letters counting 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c == "", F.lit("")).otherwise(F.conv(c, 36, 10)))
    # chunk by chunk, since the number has up to 68 digits
    rest = F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: F.when(v == "", acc).otherwise((acc * F.when(F.length(v) == 2, 100).otherwise(10) + F.coalesce(v.cast("long"), F.lit(0))) % 97))
    return rest == 1


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, "[.]"), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("00"), F.regexp_replace(p, "^0+", "")), -3, 3).try_cast("int") <= 255))


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _iban_ok(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    return F.when(F.length(s).between(15, 34), mod97(s)).otherwise(False)


def _ssn_ok(m: Column) -> Column:
    return ~m.rlike("^(000|666|9)") & ~m.rlike("^[0-9]{3}-00-") & ~m.rlike("-0000$")


@dataclass(frozen=True)
class Kind:
    """A kind of span. ``hint`` is a plain string without which a text has no match; ``base`` is the score before context."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    base: float
    words: str
    hint: str | None = None
    against: str = "(?i)example|sample|dummy|test|version"


# Possessive quantifiers and the lookbehinds keep the patterns linear in the text and free of recursion: where a run
# of characters cannot start a match, no later start in the same run can. They match what the plain forms match.
BASE_KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), THRESHOLD, "(?i)mail|contact|write|address", "@", "(?!)"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip_ok, THRESHOLD, "(?i)ip|host|server|address", ".", "(?!)"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _card_ok, THRESHOLD, "(?i)card|visa|credit|pay", None, "(?!)"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone_ok, THRESHOLD, "(?i)phone|call|tel|mobile|fax", "+", "(?!)"),
)
ADDED_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", _iban_ok, 0.6, "(?i)iban|bank|account|konto"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn_ok, 0.3, "(?i)ssn|social|security|insurance|tax", "-"),
    Kind("secret", r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|[0-9a-f]{16,64})(?![A-Za-z0-9_])", lambda m: F.lit(True), 0.3, "(?i)token|password|passwd|secret|key|AKIA|ASIA"),
)
_SPAN = "struct<kind:string,rank:int,start:bigint,end:bigint,score:double>"


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of one kind, in order of start, as an array of structs."""
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(F.split(text, kind.pattern, -1), lambda p: F.length(p).cast("long"))

    def place(pieces: Column, matches: Column) -> Column:
        """Starts of all matches; in steps, so that long lists cost no quadratic copying."""

        def inner(acc: Column, i: Column) -> Column:
            at = acc["at"] + F.get(pieces, i)
            return F.struct((at + F.length(F.get(matches, i))).alias("at"), F.concat(acc["starts"], F.array(at)).alias("starts"))

        def outer(acc: Column, j: Column) -> Column:
            block = F.aggregate(F.sequence(j, F.least(j + STEP, F.size(matches)) - 1), F.struct(acc["at"].alias("at"), F.array().cast("array<bigint>").alias("starts")), inner)
            return F.struct(block["at"].alias("at"), F.concat(acc["blocks"], F.array(block["starts"])).alias("blocks"))

        folded = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1, F.lit(STEP)), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("blocks")), outer)
        return F.flatten(folded["blocks"])

    def judged(m: Column, start: Column) -> Column:
        end = start + F.length(m)
        near = F.concat_ws(" ", F.substring(text, F.greatest(start - REACH + 1, F.lit(1)).cast("int"), F.least(start, F.lit(REACH)).cast("int")), F.substring(text, (end + 1).cast("int"), F.lit(REACH)), F.when(m.rlike("^(AKIA|ASIA)"), m))
        score = F.lit(kind.base) + F.when(near.rlike(kind.words), BOOST).otherwise(0.0) - F.when(near.rlike(kind.against), PENALTY).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    def confirmed(matches: Column) -> Column:
        both = F.arrays_zip(matches.alias("m"), place(lengths, matches).alias("s"))
        both = F.filter(both, lambda z: kind.valid(z["m"]))
        return F.filter(F.transform(both, lambda z: judged(z["m"], z["s"])), lambda s: s["score"] >= THRESHOLD)

    may = F.contains(text, F.lit(kind.hint)) if kind.hint else F.lit(True)
    nothing = F.array().cast(f"array<{_SPAN}>")
    # most texts have no valid match: positions are worked out only where one is
    some = F.when(may, F.exists(found, kind.valid)).otherwise(False)
    return F.when(some, confirmed(found)).otherwise(nothing).cast(f"array<{_SPAN}>")


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: all spans by start, then kind in the listed order, as structs (kind, rank, start, end, score).

    Null and empty texts have no spans. Spans of different kinds may overlap. Rows are independent of one another,
    so repeated rows get equal results and an empty table stays empty; there is no shuffle. A column already
    named ``out`` keeps its content under that name plus an underscore.
    """
    docs = make_room(docs, out)
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = (*BASE_KINDS, *ADDED_KINDS)
    found = F.concat(*[spans_of(t, k, i) for i, k in enumerate(kinds)])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["score"].alias("score"))))
    return docs.withColumn(out, ordered)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans become one.

    The first kind of overlapping spans names them. Null texts stay null; columns and rows stay as they are.
    """
    spans = free_name(docs, "__pii")
    found = find_pii(docs, text, spans)
    t = F.col(text)
    merged = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("parts"))
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, merged).otherwise(t)).drop(spans)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    tag = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [count(k.name) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, tag), ","), 256).alias("base_sha256"), F.array_join(F.transform("pii", tag), ",").alias("spans"))
