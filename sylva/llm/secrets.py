"""Secret scans: known formats, and sliding-window Shannon entropy of candidate strings.

Base kinds are leftmost non-overlapping matches of fixed patterns. The entropy kind takes the runs of token characters
that contain letters and digits and slides a window over each for two character classes, hexadecimal and base64. The
window keeps the sum of c*log2(c) over its characters' counts c; one character comes in and one goes out at a step, so a
step changes two counts. A run is a secret if a window of a class reaches the class's entropy, unless the allow list
knows it or a base span covers it.

Only SQL functions are used. Positions come from splitting the text at the matches: gap lengths and match lengths sum to
offsets. Positions count code points from 0, the end excluded.

Defined cases: NULL and empty texts have no span; equal rows report alike; an empty table gives an empty result; extra
columns are kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, and the fewest characters of a match (for assign: of group 2).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")

#: The run of characters that may be a secret, and its shortest length.
RUN_CHARS = "A-Za-z0-9+/_=-"
RUN = rf"(?<![{RUN_CHARS}])[{RUN_CHARS}]{{20,}}"
WINDOW = 20
# For each character class its characters and the entropy in bits from which a window of WINDOW counts.
CLASSES = (("hexadecimal", "0123456789abcdefABCDEF", 3.0), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8))
# What looks random and is none: identifiers, sample keys, paths and hyphenated words, runs of one class.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[a-z]++(?:[-_/=+][a-z]++|[-_/=+]?[0-9]{1,4}+)*+$",  # possessive: a matcher that can't go back needs no stack
)
#: Matches of a text that are walked together: arrays grow by append inside a chunk, and chunks are joined at the end.
CHUNK = 512

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: Column, pattern: str, rank: int, keep) -> Column:
    """Spans of the matches of ``pattern`` for which ``keep(match number)`` holds; the text is split only if one is there."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if rank == 0 else matches
    none = F.array().cast(_SPAN)

    def state(at: Column, old: Column | None, out: Column) -> Column:
        texts = (gaps, matches, values) if old is None else (old["gaps"], old["matches"], old["values"])
        return F.struct(at.alias("at"), texts[0].alias("gaps"), texts[1].alias("matches"), texts[2].alias("values"), out.alias("out"))

    def step(s: Column, i: Column) -> Column:
        start = s["at"] + F.length(F.get(s["gaps"], i))
        end = start + F.length(F.get(s["matches"], i))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), end.alias("end")))
        return state(end, s, F.when(keep(s, i), F.concat(s["out"], span)).otherwise(s["out"]))

    def chunk(s: Column, c: Column) -> Column:
        numbers = F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, F.size(s["matches"])) - 1)
        walked = F.aggregate(numbers, state(s["at"], s, none), step)
        return F.get(F.transform(F.array(walked), lambda w: state(w["at"], s, F.concat(s["out"], F.array(w["out"])))), 0)  # walked once

    chunks = F.sequence(F.lit(0), F.floor((F.regexp_count(text, F.lit(pattern)) - 1) / CHUNK).cast("int"))
    walked = F.aggregate(chunks, state(F.lit(0), None, F.array().cast(f"array<{_SPAN}>")), chunk, lambda s: F.flatten(s["out"]))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def base_spans(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    found = [
        _spans(text, ASSIGN, 0, lambda s, i: F.length(F.get(s["values"], i)) >= ASSIGN_LEAST),
        _spans(text, ACCESS, 1, lambda s, i: F.lit(True)),
        _spans(text, HEX, 2, lambda s, i: F.lit(True)),
    ]
    return F.sort_array(F.concat(*found))


def window_entropy(string: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy of ``window`` consecutive characters of the alphabet; 0 where there are fewer.

    A step lets one character in and one out, and changes the sum of c*log2(c) by what these two counts change; a
    character outside the alphabet empties the window."""
    clogc = lambda n: F.get(F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)]), n)
    count = lambda held, c: F.length(held) - F.length(F.replace(held, c, F.lit("")))
    lowest = lambda s: F.when(F.length(s["held"]) == window, F.least(s["lowest"], s["clogc"])).otherwise(s["lowest"])

    def step(s: Column, c: Column) -> Column:
        full = F.length(s["held"]) == window
        out = F.when(full, F.substring(s["held"], 1, 1)).otherwise(F.lit(""))
        n_in, n_out = count(s["held"], c), count(s["held"], out)
        change = F.when(c == out, F.lit(0.0)).otherwise(clogc(n_in + 1) - clogc(n_in) + F.when(full, clogc(n_out - 1) - clogc(n_out)).otherwise(F.lit(0.0)))
        known = F.instr(F.lit(alphabet), c) > 0
        return F.struct(
            F.when(known, F.concat(F.when(full, F.substring(s["held"], 2, window)).otherwise(s["held"]), c)).otherwise(F.lit("")).alias("held"),
            F.when(known, s["clogc"] + change).otherwise(F.lit(0.0)).alias("clogc"),
            lowest(s).alias("lowest"),
        )

    first = F.struct(F.lit("").alias("held"), F.lit(0.0).alias("clogc"), F.lit(math.inf).alias("lowest"))
    least = F.aggregate(F.split(string, ""), first, step, lowest)
    return F.greatest(F.lit(0.0), F.lit(math.log2(window)) - least / window)


def is_secret(string: Column) -> Column:
    """A candidate string reaches the entropy of a class and is on no allow list."""
    allowed = reduce(lambda a, b: a | b, [string.rlike(p) for p in ALLOWED])
    reached = reduce(lambda a, b: a | b, [F.round(window_entropy(string, chars), 9) >= least for _, chars, least in CLASSES])
    return F.when(allowed, F.lit(False)).otherwise(reached)


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of candidate strings that are secrets and that no base span covers."""
    text = F.coalesce(text, F.lit(""))
    found = _spans(text, RUN, 3, lambda s, i: is_secret(F.get(s["matches"], i)))
    return F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with base_spans and secret_spans (all, by start and kind): arrays of (start, rank, kind, end). Columns of these
    names, results of an earlier scan for one, are replaced; all others are kept."""
    docs = docs.withColumn("base_spans", base_spans(F.col("text")))
    return docs.withColumn("secret_spans", F.sort_array(F.concat("base_spans", entropy_spans(F.col("text"), F.col("base_spans")))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of secret_spans replaced in text; overlapping spans become one mark."""

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] > s["at"], F.concat(F.substring(s["text"], s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(F.when(s["at"] == 0, F.lit(mark)).otherwise(F.lit("")))
        return F.struct(s["text"].alias("text"), F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    first = F.struct(F.col("text").alias("text"), F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("secret_spans", first, step, lambda s: F.concat(s["out"], F.substring(s["text"], s["at"] + 1, F.length(s["text"]))))
    return docs.withColumn("text", F.when(F.size("secret_spans") > 0, done).otherwise(F.col("text")))
