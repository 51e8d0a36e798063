"""Personal data in text: findings with positions, and masking.

Each pattern is guarded by a cheap byte search, so most texts never reach the regular expression engine.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# ASCII word boundaries; Java's own \b also looks at other letters. A match ends in a digit, so its end only needs a
# following character that is no word character; one that starts with a digit is tested after that digit, which lets
# the search skip ordinary text.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_END = r"(?![A-Za-z0-9_])"
_PHONE_BODY = rf"\(?[0-9]{{3}}\)?[-.{SPACE}]?[0-9]{{3}}[-.{SPACE}]?[0-9]{{4}}"


class Pattern(NamedTuple):
    """``needles``: strings of which one must occur in the lower-cased text; ``probe``: a cheaper pattern that must
    match."""

    kind: str
    regex: str
    needles: tuple[str, ...] = ()
    probe: str | None = None


# Kinds and patterns, in the order that breaks ties between equal positions.
PATTERNS = (
    Pattern("email", r"[a-zA-Z0-9._%+-]{1,64}+@[a-zA-Z0-9.-]{1,253}\.[a-zA-Z]{2,}", ("@",)),
    Pattern(
        "api_key",
        r"(?i)(?:sk|pk|key|api|auth)-(?:live|test)?[a-zA-Z0-9]{20,}",
        ("sk-", "pk-", "key-", "api-", "auth-"),
    ),
    Pattern("ssn", rf"[0-9](?<![A-Za-z0-9_][0-9])[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}{_END}", ("-",)),
    Pattern(
        "phone",
        rf"(?=[+(0-9]){_EDGE}(?:\+?[0-9]{{1,3}}[-.{SPACE}]?)?{_PHONE_BODY}{_END}",
        probe=_PHONE_BODY,
    ),
)

FINDING = "struct<index:int,rank:int,type:string,value:string>"
_NONE = f"cast(array() as array<{FINDING}>)"


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def _hit(pattern: Pattern, content: Column, lowered: Column) -> Column:
    found = F.rlike(content, F.lit(pattern.regex))
    if pattern.probe:
        found = F.rlike(content, F.lit(pattern.probe)) & found
    if pattern.needles:
        found = contains_any(lowered, pattern.needles) & found
    return F.coalesce(found, F.lit(False))


def hit_columns(content: Column, lowered: Column) -> dict[str, Column]:
    """One boolean per kind. Add them as columns first, so that findings and masks share one test per kind."""
    return {name: _hit(p, content, lowered) for name, p in zip(hit_names(), PATTERNS)}


def hit_names() -> list[str]:
    """Names of the columns of :func:`hit_columns`, in pattern order."""
    return [f"_pii_{p.kind}" for p in PATTERNS]


def stored_hits() -> list[Column]:
    """The columns added from :func:`hit_columns`, in pattern order."""
    return [F.col(name) for name in hit_names()]


#: Findings that are handled together, so that a text of many costs little more than its length.
_BLOCK = 64
_FAR = -(1 << 60)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once, wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """An array in arrays of ``_BLOCK``; an empty one has none."""
    count = F.ceil(F.size(items) / F.lit(_BLOCK)).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.slice(items, i * _BLOCK + 1, F.lit(_BLOCK)))


def _step(x: Column, step: Column) -> Column:
    return F.greatest(step["a"], x + step["b"])


def _running(steps: Column) -> Column:
    """The value before each step, from 0, where a step ``(a, b)`` takes ``x`` to ``max(a, x + b)``.

    Such steps joined are a step again, so each block is one step for those after it. ``steps`` must be a bound value.
    """
    nothing, zero = F.struct(F.lit(_FAR).alias("a"), F.lit(0).cast("bigint").alias("b")), F.lit(0).cast("bigint")

    def joined(block: Column) -> Column:
        return F.aggregate(block, nothing, lambda f, g: F.struct(F.greatest(g["a"], f["a"] + g["b"]).alias("a"), (f["b"] + g["b"]).alias("b")))

    def inside(block: Column, first: Column) -> Column:
        return F.transform(block, lambda _, j: F.aggregate(F.slice(block, F.lit(1), j), first, _step))

    def values(blocks: Column) -> Column:
        return _let(
            F.transform(blocks, joined),
            lambda whole: F.transform(blocks, lambda b, i: _let(F.aggregate(F.slice(whole, F.lit(1), i), zero, _step), lambda first: inside(b, first))),
        )

    return F.flatten(_let(_blocks(steps), values))


def _placed(pattern: Pattern, rank: int, content: Column, hit: Column) -> Column:
    """Matches of one pattern with their offsets: sums of the lengths of matches and of the texts between them."""
    pieces = F.arrays_zip(
        F.regexp_extract_all(content, F.lit(pattern.regex), F.lit(0)).alias("m"), F.transform(F.split(content, pattern.regex, -1), F.length).alias("b")
    )
    pairs = F.filter(pieces, lambda x: x["m"].isNotNull())  # the text behind the last match has none

    def found(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: F.struct(F.lit(_FAR).alias("a"), (x["b"] + F.length(x["m"])).cast("bigint").alias("b")))
        return F.transform(
            F.arrays_zip(pairs.alias("p"), _let(lengths, _running).alias("at")),
            lambda x: F.struct(
                (x["at"] + x["p"]["b"]).cast("int").alias("index"), F.lit(rank).alias("rank"), F.lit(pattern.kind).alias("type"), x["p"]["m"].alias("value")
            ),
        )

    return F.when(hit, _let(pairs, found)).otherwise(F.expr(_NONE))


def pii_findings(content: Column, hits: list[Column]) -> Column:
    """All findings of a text as ``(index, rank, type, value)``, by position, then pattern order.

    ``index`` counts characters (code points).
    """
    return F.array_sort(F.concat(*[_placed(p, i, content, hits[i]) for i, p in enumerate(PATTERNS)]))


def _tag(kind: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit("_REDACTED]"))


def _replaced(content: Column, findings: Column) -> Column:
    """Replace findings from last to first at their original places.

    Where one ends behind the start of the next, it also takes away as many characters of what that one became. So the
    text is, for each finding in order, its tag and what stands before the next, less what the ones before take away: the
    amount carried on is ``max(overlap, carried + overlap - length)``.
    """
    placed = F.transform(
        findings,
        lambda f, k: F.struct(
            f["index"].alias("at"), (f["index"] + F.length(f["value"])).alias("end"), _tag(f["type"]).alias("tag"),
            F.coalesce(F.get(findings, k + 1)["index"], f["index"] + F.length(f["value"])).alias("next"),
        ),
    )

    def step(p: Column) -> Column:
        overlap = F.greatest(p["end"] - p["next"], F.lit(0)).cast("bigint")
        return F.struct(overlap.alias("a"), (overlap - F.length(p["tag"]) - F.greatest(p["next"] - p["end"], F.lit(0))).alias("b"))

    def piece(x: Column, text: Column, first: Column) -> Column:
        gap = F.substring(text, x["p"]["end"] - first + 1, F.greatest(x["p"]["next"] - x["p"]["end"], F.lit(0)))
        return _let(F.concat(x["p"]["tag"], gap), lambda whole: F.substring(whole, x["gone"].cast("int") + 1, F.length(whole)))

    def block(b: Column) -> Column:
        first, end = F.get(b, F.lit(0))["p"]["at"], F.element_at(b, -1)["p"]["next"]
        text = F.substring(content, first + 1, F.greatest(end - first, F.lit(0)))
        return _let(text, lambda t: F.array_join(F.transform(b, lambda x: piece(x, t, first)), ""))

    def whole(carried: Column) -> Column:
        last = F.element_at(carried, -1)
        behind = last["p"]["end"] + 1 + F.greatest(last["gone"].cast("int") - F.length(last["p"]["tag"]), F.lit(0))
        return F.concat(
            F.substring(content, F.lit(1), F.get(carried, F.lit(0))["p"]["at"]),
            F.array_join(F.transform(_blocks(carried), block), ""),
            F.substring(content, behind, F.lit(2**31 - 1)),
        )

    return _let(placed, lambda p: _let(F.arrays_zip(p.alias("p"), _let(F.transform(p, step), _running).alias("gone")), whole))


def mask_pii(content: Column, hits: list[Column], findings: Column) -> Column:
    """Text with each of its ``findings`` replaced by ``[TYPE_REDACTED]``.

    A text with one kind of finding needs a single regular replacement, as matches of one pattern never overlap. Others
    are put together from pieces, so the cost of a long text does not grow with its length times its findings.
    """
    kinds = reduce(lambda a, b: a + b, [h.cast("int") for h in hits])
    masked = F.when(kinds == 0, content).when(kinds > 1, _replaced(content, findings))
    for pattern, hit in zip(PATTERNS, hits):
        plain = F.regexp_replace(content, pattern.regex, f"[{pattern.kind.upper()}_REDACTED]")
        masked = masked.when(hit, plain)
    return masked.otherwise(content)
