"""Arguments of contract calls in their standard encoding, as hexadecimal columns: the inputs of the
decoders' queries.  Sizes are known when the query is written; values come from rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A column of hexadecimal digits and the bytes they stand for.
Sized = tuple[Column, int]


def word(number: Column | int) -> Column:
    return F.lpad(F.lower(F.hex(F.lit(number) if isinstance(number, int) else number)), 64, "0")


def static(digits: Column) -> tuple:
    """A word, or several."""
    return ("static", digits)


def data(body: Column, size: int) -> tuple:
    """Dynamic bytes of a known size."""
    return ("data", body, size)


def words_of(text: Column, size: int) -> tuple:
    """Text of a known size, as a string argument."""
    return data(F.lower(F.hex(text)), size)


def several(*items: tuple) -> tuple:
    """A tuple with dynamic parts."""
    return ("several", items)


def array(*items: tuple) -> tuple:
    return ("array", items)


def encoded(*items: tuple) -> Sized:
    """The items one after another: words in place, an offset for each dynamic one, whose body follows."""
    heads, bodies, at = [], [], 32 * len(items)
    for kind, *rest in items:
        if kind == "static":
            heads.append(rest[0])
            continue
        if kind == "data":
            body, size = rest
            pad = -size % 32
            body, size = F.concat(word(size), body, F.lit("0" * (2 * pad))), 32 + size + pad
        else:
            body, size = encoded(*rest[0])
            if kind == "array":
                body, size = F.concat(word(len(rest[0])), body), 32 + size
        heads.append(word(at))
        bodies.append(body)
        at += size
    return F.concat(*heads, *bodies), at


def call(code: str, *items: tuple) -> Sized:
    body, size = encoded(*items)
    return F.concat(F.lit(code), body), 4 + size
