"""Amounts in words, Indian numbering, both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poledger.functions.constants import number_map

# Number words.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
        "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
        "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = {"thousand": 1_000, "lakh": 100_000, "lac": 100_000, "crore": 10_000_000}
FILLER = ("rupees", "rupee", "rs", "inr", "indian", "only", "of")

VALUES = {w: n for n, w in enumerate(ONES)} | {w: 20 + 10 * n for n, w in enumerate(TENS)}
VALUES["fourty"] = 40
SCALE_WORDS = {k + s: v for k, v in SCALES.items() for s in ("", "s")}


_DEC = "decimal(20,0)"
_PAISE = ("paise", "paisa")


def _sum(closed: Column, group: Column) -> Column:
    """A number being read: what its scale words have closed, and the group still open."""
    return F.struct(closed.cast(_DEC).alias("closed"), group.cast(_DEC).alias("group"))


def _read(n: Column, w: Column, unit: Column, scale: Column) -> Column:
    """The number after one more word. Crore takes all that was read, other scales the open group."""
    open_ = F.greatest(n["group"], F.lit(1).cast(_DEC))
    scaled = F.when(w.startswith("crore"), (n["closed"] + n["group"]) * scale).otherwise(n["closed"] + open_ * scale)
    return _sum(
        F.coalesce(scaled, n["closed"]),
        F.when(scale.isNotNull(), 0).when(w == "hundred", open_ * 100).otherwise(n["group"] + F.coalesce(unit, F.lit(0).cast(_DEC))),
    )


def parse_words(value: Column) -> Column:
    """struct(amount decimal(24,2), problem string) of an amount in words.

    One pass over the words reads two numbers side by side: `all` from the start, and `part` since the
    last "and". At the word paise both are kept: if words follow, the rupees end there and the
    paise are what follows; if not, the paise are the part and the rupees what stood before it.
    """
    tokens = F.filter(
        F.split(F.trim(F.regexp_replace(F.lower(value), "[^a-z]+", " ")), " "), lambda w: (w != "") & ~w.isin(*FILLER)
    )
    none = _sum(F.lit(0), F.lit(0))

    def step(s: Column, w: Column) -> Column:
        unit, scale = (F.try_element_at(number_map(d, _DEC), w) for d in (VALUES, SCALE_WORDS))
        mark, join = w.isin(*_PAISE), w == "and"
        plain = ~mark & ~join
        return F.struct(
            F.when(plain, _read(s["all"], w, unit, scale)).otherwise(s["all"]).alias("all"),
            F.when(plain, _read(s["part"], w, unit, scale)).otherwise(none).alias("part"),
            F.when(join & (s["marks"] == 0), s["all"]).otherwise(s["before"]).alias("before"),
            F.when(mark, s["all"]).otherwise(s["led"]).alias("led"),
            F.when(mark, s["part"]).otherwise(s["held"]).alias("held"),
            (s["marks"] + mark.cast("int")).alias("marks"),
            F.when(mark, 0).otherwise(s["since"] + 1).alias("since"),
            (s["read"] + plain.cast("int")).alias("read"),
            (s["odd"] | (plain & unit.isNull() & scale.isNull() & (w != "hundred"))).alias("odd"),
        )

    start = F.struct(
        none.alias("all"), none.alias("part"), none.alias("before"), none.alias("led"), none.alias("held"),
        F.lit(0).alias("marks"), F.lit(0).alias("since"), F.lit(0).alias("read"), F.lit(False).alias("odd"),
    )

    def finish(s: Column) -> Column:
        total = lambda n: n["closed"] + n["group"]
        follows = s["since"] > 0
        rupees = F.when(s["marks"] == 0, total(s["all"])).when(follows, total(s["led"])).otherwise(total(s["before"]))
        paise = F.when(s["marks"] == 0, F.lit(0).cast(_DEC)).when(follows, total(s["part"])).otherwise(total(s["held"]))
        problem = (
            F.when(s["marks"] > 1, "paise mentioned twice")
            .when(s["read"] == 0, "no amount")
            .when(s["odd"], "not a number word")
            .when(paise >= 100, "paise must be below 100")
        )
        amount = (rupees + paise * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(24,2)")
        return F.struct(F.when(problem.isNull(), amount).alias("amount"), problem.alias("problem"))

    return F.when(value.isNotNull(), F.aggregate(tokens, start, step, finish))


def _title(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w.capitalize()) for w in words])


def _below_hundred(n: Column) -> Column:
    """Words of 0..99, '' for 0."""
    ones = F.element_at(_title(ONES), (n % 10 + 1).cast("int"))
    tens = F.element_at(_title(("ten", *TENS)), F.greatest((n / 10).cast("int"), F.lit(1)))
    return (
        F.when(n == 0, "")
        .when(n < 20, F.element_at(_title(ONES), F.least(n, F.lit(19)).cast("int") + 1))
        .when(n % 10 == 0, tens)
        .otherwise(F.concat_ws(" ", tens, ones))
    )


def _below_crore(n: Column) -> Column:
    """Words of 0..9999999, '' for 0."""
    parts = []
    for size, span, name in ((100_000, 100, "Lakh"), (1_000, 100, "Thousand"), (100, 10, "Hundred")):
        g = F.floor(n / size) % span
        parts.append(F.when(g > 0, F.concat_ws(" ", _below_hundred(g), F.lit(name))))
    parts.append(F.when(n % 100 > 0, _below_hundred(n % 100)))
    return F.concat_ws(" ", *parts)


def amount_to_words(amount: Column) -> Column:
    """'Rupees Two Lakh ... and Fifty Paise Only' of a non-negative amount below 1e14."""
    rupees = F.floor(amount).cast("bigint")
    paise = ((amount - F.floor(amount)) * 100).cast("int")
    crores = F.floor(rupees / 10_000_000)
    head = F.when(crores > 0, F.concat_ws(" ", _below_crore(crores), F.lit("Crore")))
    tail = F.nullif(_below_crore(rupees % 10_000_000), F.lit(""))
    whole = F.coalesce(F.nullif(F.concat_ws(" ", head, tail), F.lit("")), F.lit("Zero"))
    cents = F.when(paise > 0, F.concat_ws(" ", F.lit("and"), _below_hundred(paise), F.lit("Paise")))
    return F.when(amount >= 0, F.concat_ws(" ", F.lit("Rupees"), whole, cents, F.lit("Only")))
