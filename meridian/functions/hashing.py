"""32-bit hashes of strings and numbers as column expressions. All intermediate products stay below 2**63."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash functions.
OFFSET = 0x811C9DC5
OFFSET_B = 0x9E3779B9
PRIME = 0x01000193
MIX_A = 0x21F0AAAD
MIX_B = 0x735A2D97
MASK = 0xFFFFFFFF


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def _mask(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def times32(c: Column, factor: int) -> Column:
    """Product modulo 2**32 of a number below 2**32 and a factor below 2**31."""
    return _mask(c * F.lit(factor))


def mix32(c: Column) -> Column:
    """The finishing step: two rounds of shift, xor and multiply, and a last shift."""
    a = times32(c.bitwiseXOR(F.shiftright(c, 16)), MIX_A)
    b = times32(a.bitwiseXOR(F.shiftright(a, 15)), MIX_B)
    return b.bitwiseXOR(F.shiftright(b, 15))


def units(s: Column) -> Column:
    """UTF-16 code units of a string, as longs."""
    code = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    pairs = F.transform(code, lambda c: F.when(c > 0xFFFF, F.array(F.shiftright(c - 0x10000, 10) + 0xD800, (c - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00)).otherwise(F.array(c)))
    return F.flatten(pairs)


def text_hash(s: Column, seed) -> Column:
    """FNV-1a over whole code units."""
    return F.aggregate(units(s), _c(seed), lambda h, c: times32(h.bitwiseXOR(c), PRIME))


def byte_hash(s: Column, seed=OFFSET) -> Column:
    """FNV-1a over the low and high bytes of each code unit, mixed."""
    def step(h, c):
        low = times32(h.bitwiseXOR(c.bitwiseAND(F.lit(0xFF))), PRIME)
        return times32(low.bitwiseXOR(F.shiftright(c, 8)), PRIME)

    return F.aggregate(units(s), _c(seed), step, mix32)


def number_hash(seed, *values) -> Column:
    h = mix32(_c(seed))
    for v in values:
        h = mix32(h.bitwiseXOR(_mask(_c(v))))
    return h


def derived_seed(base, *parts: Column | int | tuple) -> Column:
    """A seed from a base and parts: numbers as they are, strings as ('s', column)."""
    h = mix32(_c(base))
    for p in parts:
        h = byte_hash(p[1], h) if isinstance(p, tuple) else number_hash(h, p)
    return h


def pair_hash(a: Column, b: Column, seed=0) -> Column:
    """Of an ordered pair of strings."""
    return derived_seed(seed, ("s", a), ("s", F.lit("\0")), ("s", b))


def unordered_pair_hash(a: Column, b: Column, seed=0) -> Column:
    return pair_hash(F.least(a, b), F.greatest(a, b), seed)


def unit_float(h: Column) -> Column:
    """From [0, 2**32) to [0, 1)."""
    return h / F.lit(float(1 << 32))


def signed_float(h: Column) -> Column:
    return unit_float(h) * 2 - 1


def _framed(p: Column) -> Column:
    return F.concat(F.size(units(p)).cast("string"), F.lit(":"), p, F.lit(";"))


def parts_hash(parts: Column) -> Column:
    """FNV-1a over the framed parts of an array of strings."""
    return text_hash(F.array_join(F.transform(parts, _framed), ""), OFFSET)


def signature(parts: Column, prefix: str) -> Column:
    """prefix-16 hex digits: two chains of FNV-1a over the framed parts, the second fed by the first."""
    start = F.struct(F.lit(OFFSET).cast("long").alias("a"), F.lit(OFFSET_B).cast("long").alias("b"))

    def step(s, p):
        return F.element_at(F.transform(F.array(text_hash(_framed(p), s["a"])), lambda a: F.struct(a.alias("a"), text_hash(_framed(p), s["b"].bitwiseXOR(a)).alias("b"))), 1)

    def out(s):
        return F.concat(F.lit(prefix + "-"), F.lower(F.lpad(F.hex(s["a"]), 8, "0")), F.lower(F.lpad(F.hex(s["b"]), 8, "0")))

    return F.aggregate(parts, start, step, out)


def filter_signature(orphans: bool, prefixes: Column) -> Column:
    return signature(F.concat(F.array(F.lit(f"orphans:{int(orphans)}")), F.transform(prefixes, lambda p: F.concat(F.lit("exclude:"), p))), "gf1")


def times(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of two numbers below 2**32, by halves."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    top = (high * b.bitwiseAND(F.lit(0xFFFF)) + low * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF))
    return _mask(F.shiftleft(top, 16) + low * b.bitwiseAND(F.lit(0xFFFF)))


DRAW_STEP = 0x6D2B79F5  #: fixed value of the generator


def draw(seed, n) -> Column:
    """The n-th number (from 1), below 2**32, of the generator with this seed. Its state only counts, so any draw is a formula of n.

    With seeds below 2**32 and n below 2**31.
    """
    v = _mask(mix32(_c(seed)) + times(_mask(_c(n)), F.lit(DRAW_STEP).cast("long")))
    v = times(v.bitwiseXOR(F.shiftright(v, 15)), v.bitwiseOR(F.lit(1)))
    v = v.bitwiseXOR(_mask(v + times(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(F.lit(61)))))
    return v.bitwiseXOR(F.shiftright(v, 14))


def draw_unit(seed, n) -> Column:
    """The n-th draw within 0 and 1, without 1."""
    return draw(seed, n) / F.lit(float(1 << 32))


def draw_below(seed, n, most) -> Column:
    """The n-th draw as a whole number from 0 to most - 1."""
    return F.floor(draw_unit(seed, n) * _c(most)).cast("long")


def effective_seed(base: Column, generation: Column, signature: Column, version: int = 10) -> Column:
    """The seed of a layout run, from whole numbers, the graph's signature and the algorithm's version."""
    parts = (base.cast("long").cast("string"), generation.cast("long").cast("string"), signature, F.lit(str(version)))
    return text_hash(F.concat(*map(_framed, parts)), OFFSET)
