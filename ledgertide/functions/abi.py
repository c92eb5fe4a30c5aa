"""Reading of contract calls as bytes: words, addresses, whole numbers of 256 bits, dynamic bytes
and tuples.

Calldata is turned into binary once; what it holds is read by ``substring`` at offsets, so a
column that follows an offset is one projection over the column before it and stays in
generated code.  Positions count bytes from the call's first, its selector included; each
reader gives null for what lies beyond the end or isn't of its form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARGUMENTS = 4
WORD = 32
#: A whole number is ten limbs of eight decimal digits, the lowest first.
LIMB, LIMBS = 10**8, 10


def let(value: Column, body) -> Column:
    """body(value), with value written, and computed, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text_: Column, pattern: str) -> Column:
    """What the pattern's group matches, or null; like every reader here it names its argument once, for
    readers are nested and generated code has a limit."""
    return F.get(F.regexp_extract_all(text_, F.lit(pattern), F.lit(1)), F.lit(0))


def raw(text_: Column) -> Column:
    """Hexadecimal text, with or without 0x, as bytes (an odd last digit is dropped); null for
    anything else."""
    return let(_found(F.trim(text_), "^(?:0[xX])?([0-9a-fA-F]*)$"), lambda x: F.unhex(F.substring(x, F.lit(1), F.length(x) - F.length(x) % 2)))


def selector(data: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(F.substring(data, 1, ARGUMENTS))))


def word(data: Column, at: Column | int) -> Column:
    """32 bytes, or fewer where the call ends; the readers of words take whole ones only."""
    begin = F.lit(at + 1) if isinstance(at, int) else F.least(at + 1, F.lit(2**31 - 64)).cast("int")
    return F.substring(data, begin, F.lit(WORD))


def slot(data: Column, base: Column | int, number: Column | int) -> Column:
    """The word that is ``number`` words after ``base``."""
    return word(data, (F.lit(base) if isinstance(base, int) else base) + WORD * number)


def whole(word_: Column) -> Column:
    """The word; null unless all of it is there."""
    return F.unhex(_found(F.hex(word_), "^(.{64})$"))


def small(word_: Column) -> Column:
    """A word below 2**31, as every offset and length that can be followed is."""
    return F.conv(_found(F.hex(word_), "^0{56}([0-7].{7})$"), 16, 10).cast("long")


def below(data: Column, at: Column) -> Column:
    """``small`` of the word at ``at``, without a pattern: both are named several times, so each is best a
    column of its own."""
    begin = F.least(at + 1, F.lit(2**31 - 64)).cast("int")
    low = F.substring(data, begin + (WORD - 4), F.lit(4))
    fits = (F.substring(data, begin, F.lit(WORD - 4)) == F.lit(bytes(WORD - 4))) & (F.length(low) == 4) & (low < F.lit(b"\x80\0\0\0"))
    return F.when(fits, F.conv(F.hex(low), 16, 10).cast("long"))


def address_of(word_: Column) -> Column:
    """``address`` of a word that is a column of its own."""
    twenty = F.substring(word_, 13, 20)
    return F.when((F.length(word_) == WORD) & (F.substring(word_, 1, 12) == F.lit(bytes(12))) & (twenty != F.lit(bytes(20))), as_address(twenty))


def address(word_: Column) -> Column:
    """A word whose first twelve bytes are zero and whose others aren't all, so that a misread word
    never makes an address up."""
    return F.concat(F.lit("0x"), F.lower(_found(F.hex(word_), "^0{24}((?!0{40}).{40})$")))


def as_address(twenty: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(twenty)))


def follow(data: Column, base: Column | int, number: Column | int) -> Column:
    """Where the offset in a slot of a tuple that begins at ``base`` leads."""
    return (F.lit(base) if isinstance(base, int) else base) + small(slot(data, base, number))


def blob(data: Column, at: Column) -> Column:
    """The dynamic bytes whose length stands at ``at`` (best a column of its own); null where not all
    are there."""
    size = small(word(data, at))
    return F.when(at + WORD + size <= F.length(data), F.substring(data, (at + WORD + 1).cast("int"), size.cast("int")))


def text(bytes_: Column) -> Column:
    """Bytes as text; null where they aren't UTF-8, empty or longer than 256."""
    return F.when(F.length(bytes_).between(1, 256), F.try_validate_utf8(bytes_.cast("string")))


# ---- whole numbers of 256 bits, exact


def _sums(parts: Column) -> Column:
    """Eight numbers of 32 bits, the lowest first, as ten limbs that aren't proper yet."""
    scales = [[2 ** (32 * i) // LIMB**j % LIMB for i in range(8)] for j in range(LIMBS)]
    return F.array(*(reduce(lambda a, b: a + b, [F.get(parts, F.lit(i)) * F.lit(s).cast("long") for i, s in enumerate(row) if s], F.lit(0).cast("long")) for row in scales))


def limbs(word_: Column) -> Column:
    """A word's number as ten proper limbs."""
    parts = let(F.hex(word_), lambda x: F.when(F.length(x) == 2 * WORD, F.array(*(F.conv(F.substring(x, 57 - 8 * i, 8), 16, 10).cast("long") for i in range(8)))))
    return F.slice(carried(let(parts, lambda p: F.when(p.isNotNull(), _sums(p)))), 1, LIMBS)


def carried(sums: Column) -> Column:
    """Limbs that may be too large (sums of limbs) as proper ones; the last holds what is over."""
    kind = "struct<done: array<bigint>, over: bigint>"
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("long").alias("over")).cast(kind)
    merge = lambda s, x: F.struct(F.concat(s["done"], F.array(F.pmod(x + s["over"], F.lit(LIMB).cast("long")))).alias("done"), _div(x + s["over"]).alias("over")).cast(kind)
    return F.aggregate(sums, start, merge, lambda s: F.concat(s["done"], F.array(s["over"])))


def _div(x: Column) -> Column:
    return F.call_function("div", x, F.lit(LIMB).cast("long"))


def digits(proper: Column) -> Column:
    """Proper limbs as decimal digits without leading zeros."""
    return F.regexp_replace(F.array_join(F.transform(F.reverse(proper), lambda x: F.lpad(x.cast("string"), 8, "0")), ""), r"^0+(?=\d)", "")


def number(word_: Column) -> Column:
    """A word's number as decimal digits, all 256 bits of it."""
    return digits(limbs(word_))


def step(value: Column) -> Column:
    """value (a struct, or one column) behind a generator: filters on it stay above, and what names it several
    times reads a column, where the optimizer would compute it again."""
    return F.explode_outer(F.array(value))


def numbered(rows: DataFrame, *names: str) -> DataFrame:
    """rows with the words of the named columns as ``number`` writes them, by steps of plain columns: limbs are no
    arrays, and a number of 64 bits needs none."""
    for name in names:
        w, parts, total = F.col(name), f"{name} parts", f"{name} sums"
        short = F.substring(w, 1, WORD - 8) == F.lit(bytes(WORD - 8))
        part = lambda i: F.conv(F.hex(F.substring(w, WORD - 3 - 4 * i, 4)), 16, 10).cast("long")  # noqa: B023, E731
        rows = rows.withColumn(parts, step(F.when((F.length(w) == WORD) & ~short, F.struct(*(part(i).alias(f"p{i}") for i in range(8))))))
        scales = [[2 ** (32 * i) // LIMB**j % LIMB for i in range(8)] for j in range(LIMBS)]
        sums = [reduce(lambda a, b: a + b, [F.col(f"{parts}.p{i}") * F.lit(s).cast("long") for i, s in enumerate(row) if s], F.lit(0).cast("long")) for row in scales]
        rows = rows.withColumn(total, step(F.when(F.col(parts).isNotNull(), F.struct(*(s.alias(f"s{j}") for j, s in enumerate(sums))))))
        carries = [F.col(f"{total}.s0")]
        for j in range(1, LIMBS):
            carries.append(F.col(f"{total}.s{j}") + _div(carries[-1]))
        wide = F.concat(*(F.lpad((c % LIMB).cast("string"), 8, "0") for c in reversed(carries)))
        narrow = F.when((F.length(w) == WORD) & short, F.conv(F.hex(F.substring(w, WORD - 7, 8)), 16, 10))
        rows = rows.withColumn(name, F.coalesce(narrow, F.ltrim(wide, F.lit("0")))).drop(parts, total)
    return rows


def limbs_of_digits(text_: Column) -> Column:
    """Decimal digits (at most 80) as limbs; null for anything else."""
    padded = F.lpad(_found(F.trim(text_), r"^(\d{1,80})$"), LIMBS * 8, "0")
    return let(padded, lambda x: F.when(x.isNotNull(), F.array(*(F.substring(x, 1 + 8 * (LIMBS - 1 - j), 8).cast("long") for j in range(LIMBS)))))


def limb_sums(limbs_: Column) -> list[Column]:
    """Aggregates whose array, carried, is the exact sum of whole numbers (up to 10**10 rows)."""
    return [F.sum(F.get(limbs_, F.lit(j))).alias(f"limb{j}") for j in range(LIMBS)]


def summed() -> Column:
    """The digits of the sums that ``limb_sums`` made."""
    return digits(carried(F.array(*(F.col(f"limb{j}") for j in range(LIMBS)))))


def scaled(digits_: Column, places: Column | int) -> Column:
    """Whole units of the smallest part as a decimal string, exact for any number of digits."""
    n = F.lit(places) if isinstance(places, int) else places
    padded = F.lpad(digits_, F.greatest(F.length(digits_), n + 1), F.lit("0"))
    return let(padded, lambda x: F.regexp_replace(F.concat(F.substring(x, F.lit(1), F.length(x) - n), F.lit("."), F.substring(x, F.length(x) - n + 1, n)), r"\.?0*$", ""))


# ---- Base58, as accounts of some chains are written

BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_GROUP = 58**5


def base58(bytes32: Column) -> Column:
    """32 bytes in Base58 without a checksum: long division by 58**5, five digits at a time."""
    kind = "struct<rest: array<bigint>, groups: array<bigint>>"
    sixteen = let(F.hex(bytes32), lambda x: F.array(*(F.conv(F.substring(x, 4 * i + 1, 4), 16, 10).cast("long") for i in range(16))))

    def divide(rest: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("q"), F.lit(0).cast("long").alias("r"))
        return F.aggregate(rest, start, lambda s, x: F.struct(F.concat(s["q"], F.array(F.call_function("div", s["r"] * 65536 + x, F.lit(_GROUP).cast("long")))).alias("q"), ((s["r"] * 65536 + x) % _GROUP).cast("long").alias("r")))

    def step(s: Column, _: Column) -> Column:
        # the quotient and the remainder of one division
        return F.get(F.transform(F.array(divide(s["rest"])), lambda d: F.struct(d["q"].alias("rest"), F.concat(F.array(d["r"]), s["groups"]).alias("groups")).cast(kind)), F.lit(0))

    groups = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.struct(sixteen.alias("rest"), F.array().cast("array<bigint>").alias("groups")).cast(kind), step, lambda s: s["groups"])
    letter = lambda g, k: F.substring(F.lit(BASE58), (F.pmod(F.call_function("div", g, F.lit(58**k).cast("long")), F.lit(58).cast("long")) + 1).cast("int"), F.lit(1))
    letters = F.array_join(F.transform(groups, lambda g: F.concat(*(letter(g, k) for k in range(4, -1, -1)))), "")
    zeros = F.floor((64 - F.length(F.regexp_replace(F.hex(bytes32), "^(00)+", ""))) / 2).cast("int")
    return F.concat(F.repeat(F.lit("1"), zeros), F.regexp_replace(letters, "^1+", ""))
