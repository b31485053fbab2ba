"""Text features and the repair of JSON records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words whose presence marks a kind of error message.
ERROR_WORDS = {
    "kw_syntax": ("syntaxerror", "invalid syntax", "unexpected eof", "unexpected indent", "eol"),
    "kw_runtime": ("typeerror", "valueerror", "keyerror", "indexerror", "attributeerror", "nameerror"),
    "kw_network": ("connectionerror", "econnrefused", "dns", "socket", "httperror", "ssl", "unreachable"),
    "kw_permission": ("permission denied", "access denied", "eacces", "forbidden", "403", "not permitted"),
    "kw_timeout": ("timeout", "timed out", "timeouterror", "deadline"),
    "kw_resource": ("memoryerror", "oom", "out of memory", "disk full", "enospc", "no space left"),
}
# Signs of a stack trace and of program code.
TRACE = r"traceback|stack trace|at .+\(.+:[0-9]+\)"
#: A text in brackets, or two bars on one line; spaces, lines and the end of a text are those of RE2 and not Java's.
STRUCTURE = r"\A[ \t\n\f\r]*[\[{](?s:.*)[\]}][ \t\n\f\r]*\z|\|[^\n]*\|"
CODE = r"(?m)```|\bdef \b|\bclass \b|\bfunction\b|\bimport \b|=>|;[ \t]*$"


def share(x: Column, whole: int) -> Column:
    """``x`` over ``whole``, at most one, in millionths."""
    return F.least(F.lit(1_000_000), F.floor(x.cast("long") * 1_000_000 / whole)).cast("long")


def error_features(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    found = {"message_length": share(F.length(text), 2000), "has_traceback": flag(low.rlike(TRACE)), "line_count": share(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), 100), "has_suggestion": flag(F.contains(low, F.lit("did you mean")))}
    for name, words in ERROR_WORDS.items():
        any_ = F.lit(False)
        for w in words:
            any_ = any_ | F.contains(low, F.lit(w))
        found[name] = flag(any_)
    return found


def effort_features(text: Column) -> dict[str, Column]:
    words = F.size(F.regexp_extract_all(text, F.lit("[^ \\t\\r\\n]+"), F.lit(0)))
    return {"file_size": share(F.length(text), 102_400), "tokens": share(words, 2000), "is_code": F.when(text.rlike(CODE), 1).otherwise(0)}


def compressibility_features(text: Column) -> dict[str, Column]:
    lines = F.split(text, "\n")
    return {"raw_length": share(F.length(text), 102_400), "repetition": F.floor((F.size(lines) - F.size(F.array_distinct(lines))).cast("long") * 1_000_000 / F.size(lines)).cast("long"), "structure": F.when(text.rlike(STRUCTURE), 1).otherwise(0)}


def clean_json(raw: Column) -> Column:
    """The outer object of a text, without a code fence and trailing commas."""
    t = F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*|\s*```$", "")
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    inner = F.when((first > 0) & (F.instr(t, "}") > 0) & (last > first), F.substring(t, first, last - first + 1)).otherwise(t)
    return F.regexp_replace(inner, r",\s*([}\]])", "$1")


def enforce_int(rows: DataFrame, raw: str, key: str, low: int, high: int, default: int | None = None) -> DataFrame:
    """``rows`` with valid, value, repaired, coerced, clamped and error for one whole-number field of a JSON text.

    A text value that is a whole number is coerced, a value out of range is held at its end; a missing field takes the default, or is an error.
    """
    cleaned = clean_json(F.col(raw))
    parsed = F.try_variant_get(F.try_parse_json(cleaned), "$", "variant").isNotNull() if hasattr(F, "try_parse_json") else F.get_json_object(cleaned, "$").isNotNull()
    rows = rows.withColumns({"__c": cleaned, "__ok": F.coalesce(parsed, F.lit(False))}).withColumn("__v", F.get_json_object("__c", f"$.{key}"))
    number = F.when(F.col("__v").rlike("^-?[0-9]{1,18}$"), F.col("__v").cast("long"))
    text = F.col("__c").rlike(rf'"{key}"\s*:\s*"')
    rows = rows.withColumns({"__n": number, "__t": text})
    value = F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), F.col("__n"))), F.when(F.col("__v").isNull() & F.col("__ok"), F.lit(default).cast("long")))
    error = F.when(~F.col("__ok"), "syntax").when(F.col("__v").isNull() & F.lit(default is None), "missing").when(F.col("__v").isNotNull() & F.col("__n").isNull(), "type")
    return rows.withColumns({
        "value": F.when(error.isNull(), value), "repaired": F.col("__ok") & (F.col("__c") != F.trim(raw)), "coerced": F.col("__ok") & F.coalesce(F.col("__n").isNotNull() & F.col("__t"), F.lit(False)),
        "clamped": F.coalesce((F.col("__n") < low) | (F.col("__n") > high), F.lit(False)), "error": F.coalesce(error, F.lit("")),
    }).withColumn("valid", F.col("error") == "").drop("__c", "__ok", "__v", "__n", "__t")
