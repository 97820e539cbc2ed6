"""Byte-level functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what the masked checksum adds after rotating right by 15 bits.
MASK_DELTA = 0xA282EAD8
_U32 = 0xFFFFFFFF


def successor(text: str | bytes) -> str | bytes | None:
    """The least key above every key that starts with `text`; None if there is none (empty or all at the maximum)."""
    if isinstance(text, bytes):
        cut = text.rstrip(b"\xff")
        return cut[:-1] + bytes([cut[-1] + 1]) if cut else None
    for i in range(len(text) - 1, -1, -1):
        if (c := ord(text[i])) < 0x10FFFF:
            return text[:i] + chr(0xE000 if 0xD7FF <= c < 0xE000 else c + 1)
    return None


def varint_length(x: Column) -> Column:
    """Bytes of a non-negative number in groups of seven bits."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(x < F.lit(1 << 7 * n), n).otherwise(out)
    return out.cast("bigint")


def entry_size(key: Column, value: Column) -> Column:
    """Encoded bytes of one write: key with its 8-byte tag, and value, each with a varint length before it."""
    k, v = F.octet_length(key).cast("bigint") + 8, F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
    return varint_length(k) + k + varint_length(v) + v


def pack_tag(seq: Column, op: Column) -> Column:
    return F.shiftleft(seq.cast("bigint"), 8).bitwiseOR(op.cast("bigint"))


def tag_seq(tag: Column) -> Column:
    return F.shiftrightunsigned(tag, 8)


def tag_op(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(255).cast("bigint"))


def fixed_le(x: Column, width: int = 8) -> Column:
    """Hex text of a number's little-endian bytes; width 4 or 8."""
    big = F.lpad(F.hex(x.cast("bigint")), 16, "0")
    return F.concat(*[F.substring(big, 16 - 2 * i - 1, 2) for i in range(width)])


def crc_mask(crc: Column) -> Column:
    crc = crc.cast("bigint")
    turned = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(_U32))
    return (turned + F.lit(MASK_DELTA)).bitwiseAND(F.lit(_U32))


def crc_unmask(masked: Column) -> Column:
    turned = (masked.cast("bigint") - F.lit(MASK_DELTA)).bitwiseAND(F.lit(_U32))
    return F.shiftrightunsigned(turned, 17).bitwiseOR(F.shiftleft(turned, 15)).bitwiseAND(F.lit(_U32))


def checksum(x: Column, seed: Column | None = None) -> Column:
    """CRC-32 of the bytes; with a seed, of the seed's four little-endian bytes and the bytes after them."""
    return F.crc32(x if seed is None else F.concat(F.unhex(fixed_le(seed, 4)), x.cast("binary")))


def _number(hex_text: Column) -> Column:
    """The number that up to 16 hex digits write, as a signed bigint."""
    return F.conv(hex_text, 16, -10).cast("bigint")


def fixed_decode(x: Column, width: int = 8) -> Column:
    """The number in the first `width` little-endian bytes of a binary: an unsigned one of four bytes, a signed one of eight."""
    h = F.hex(F.substring(x, 1, width))
    return _number(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]))


def varint(x: Column) -> Column:
    """A number as binary in groups of seven bits, the lowest first, all but the last with the high bit set; negative numbers, read as unsigned,
    take ten bytes."""
    x = x.cast("bigint")
    groups = F.when(x < 0, 10).otherwise(varint_length(x)).cast("int")

    def group(i: Column) -> Column:
        bits = F.when(i < 9, F.call_function("shiftrightunsigned", x, 7 * F.least(i, F.lit(8)))).otherwise(F.call_function("shiftrightunsigned", x, F.lit(63)))
        return F.lpad(F.hex(bits.bitwiseAND(F.lit(127)) + F.when(i < groups - 1, 128).otherwise(0)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), group), ""))


def varint_decode(x: Column, at: Column | int = 0) -> Column:
    """(value, next) of the varint that starts at byte `at` of a binary; null if the bytes end within it."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda i: _number(F.hex(F.substring(x, at + i + 1, F.lit(1))))
    here = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(byte(i).alias("b"), i.alias("i")))
    last = F.get(F.filter(here, lambda g: g["b"] < 128), F.lit(0))["i"]
    parts = F.filter(here, lambda g: g["i"] <= last)
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, g: n.bitwiseOR(F.call_function("shiftleft", g["b"].bitwiseAND(F.lit(127)), 7 * g["i"])))
    return F.when(last.isNotNull(), F.struct(value.alias("value"), (at + last + 1).alias("next")))


def length_prefixed(x: Column) -> Column:
    """Bytes with their length before them."""
    return F.concat(varint(F.octet_length(x)), x.cast("binary"))


def length_prefixed_decode(x: Column, at: Column | int = 0) -> Column:
    """(value, next) of the length-prefixed bytes that start at byte `at`."""
    n = varint_decode(x, at)
    return F.when(n.isNotNull(), F.struct(F.substring(x, n["next"] + 1, n["value"].cast("int")).alias("value"), (n["next"] + n["value"]).cast("int").alias("next")))


# Fixed values of the 32-bit hash: its multiplier, and the seed that filters use.
HASH_MULTIPLIER, FILTER_SEED = 0xC6A4A793, 0xBC9F1D34


def _once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is evaluated once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _times(h: Column) -> Column:
    """The low 32 bits of h times HASH_MULTIPLIER, in halves so that no product leaves 64 bits."""
    high = F.call_function("shiftleft", (h * (HASH_MULTIPLIER >> 16)).bitwiseAND(F.lit(0xFFFF)), F.lit(16))
    return (h * (HASH_MULTIPLIER & 0xFFFF) + high).bitwiseAND(F.lit(_U32))


def hash32(x: Column, seed: int = FILTER_SEED) -> Column:
    """A 32-bit hash of the bytes, as an unsigned bigint: words of four little-endian bytes are added, multiplied and folded one by one, then the one to
    three bytes that are left."""
    h, n = F.hex(x.cast("binary")), F.octet_length(x)
    byte = lambda i: F.substr(h, 2 * i + 1, F.lit(2))
    little = lambda i, k: _number(F.concat(*[byte(i + j) for j in reversed(range(k))]))
    fold = lambda v, bits: v.bitwiseXOR(F.shiftrightunsigned(v, bits))
    start = _times(n.cast("bigint")).bitwiseXOR(F.lit(seed & _U32))
    words = F.floor(n / 4).cast("int")
    steps = F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(F.array().cast("array<int>"))
    mixed = lambda v, bits: _once(v.bitwiseAND(F.lit(_U32)), lambda s: _once(_times(s), lambda t: fold(t, bits)))
    whole = F.aggregate(steps, start, lambda acc, i: mixed(acc + little(4 * i, 4), 16))
    rest, at = n - 4 * words, 4 * words
    tail = F.when(rest == 3, little(at, 3)).when(rest == 2, little(at, 2)).otherwise(little(at, 1))
    return _once(whole, lambda w: F.when(rest == 0, w).otherwise(mixed(w + tail, 24)))


# The codes of the log's pieces and of entries.
RECORD_TYPES = {0: "zero", 1: "full", 2: "first", 3: "middle", 4: "last"}
VALUE_TYPES = {0: "deletion", 1: "value"}


def _decoded(code: Column, names: dict[int, str], what: str) -> Column:
    out = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(code.cast("string"), F.lit("null")))).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def record_type(code: Column) -> Column:
    """The name of a log record's type; an unknown code fails the query."""
    return _decoded(code, RECORD_TYPES, "record type")


def value_type(code: Column) -> Column:
    """The name of an entry's type; an unknown code fails the query."""
    return _decoded(code, VALUE_TYPES, "value type")


#: Fixed value: the greatest sequence number, of 56 bits.
MAX_SEQ = (1 << 56) - 1


def internal_key(key: Column, seq: Column, op: Column) -> Column:
    """A key's bytes with its tag of eight little-endian bytes behind them."""
    return F.concat(key.cast("binary"), F.unhex(fixed_le(pack_tag(seq, op))))


def user_key(internal: Column) -> Column:
    return F.substring(internal, F.lit(1), F.octet_length(internal) - 8)


def internal_tag(internal: Column) -> Column:
    return fixed_decode(F.substring(internal, F.octet_length(internal) - 7, F.lit(8)))


def separator_bytes(a: Column, b: Column) -> Column:
    """A shortest key s with a <= s < b over bytes: a up to the first byte that differs, which is raised by one if that stays below b's; else a."""
    a, b = a.cast("binary"), b.cast("binary")
    least = F.least(F.octet_length(a), F.octet_length(b))
    byte = lambda x, i: _number(F.hex(F.substring(x, i + 1, F.lit(1))))
    places = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
    n = F.get(F.filter(places, lambda i: F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1))), F.lit(0))
    raised = F.concat(F.substring(a, F.lit(1), n), F.unhex(F.lpad(F.hex(byte(a, n) + 1), 2, "0")))
    return F.when(n.isNotNull() & (byte(a, n) + 1 < byte(b, n)), raised).otherwise(a)


def successor_bytes(k: Column) -> Column:
    """The first byte below 255 raised by one and the rest cut, over bytes; the key itself if there is none."""
    k = k.cast("binary")
    top = F.floor(F.length(F.regexp_extract(F.hex(k), "^((?:FF)*)", 1)) / 2).cast("int")
    byte = _number(F.hex(F.substring(k, top + 1, F.lit(1))))
    return F.when(top < F.octet_length(k), F.concat(F.substring(k, F.lit(1), top), F.unhex(F.lpad(F.hex(byte + 1), 2, "0")))).otherwise(k)


def _shorter(internal: Column, short: Column) -> Column:
    """The shortened user key with the tag that seeks before all its versions, if it is shorter and greater; else the internal key."""
    own = user_key(internal)
    tagged = internal_key(short, F.lit(MAX_SEQ), F.lit(1))
    return F.when((F.octet_length(short) < F.octet_length(own)) & (own < short), tagged).otherwise(internal)


def internal_separator(a: Column, b: Column) -> Column:
    return _shorter(a, separator_bytes(user_key(a), user_key(b)))


def internal_successor(k: Column) -> Column:
    return _shorter(k, successor_bytes(user_key(k)))


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that both texts start with; 0 if either is null."""
    differs = lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))
    least = F.coalesce(F.least(F.length(a), F.length(b)), F.lit(0))  # least() passes over nulls, but both lengths must be known
    least = F.when(a.isNull() | b.isNull(), 0).otherwise(least)
    first = F.when(least > 0, F.get(F.filter(F.sequence(F.lit(1), least), differs), F.lit(0)))
    return F.coalesce(first - 1, least).cast("bigint")


def shortest_separator(a: Column, b: Column) -> Column:
    """A shortest text s with a <= s < b, made by raising the first character in which they differ; a if there is none. ASCII keys."""
    n = shared_prefix(a, b).cast("int")
    x, y = F.ascii(F.substr(a, n + 1, F.lit(1))), F.ascii(F.substr(b, n + 1, F.lit(1)))
    inside = (n < F.least(F.length(a), F.length(b))) & (x < 127) & (x + 1 < y)
    return F.when(inside, F.concat(F.substr(a, F.lit(1), n), F.char(x + 1))).otherwise(a)


def short_successor(k: Column) -> Column:
    """The first character below the last ASCII one raised, the rest cut; k itself if there is none. ASCII keys."""
    top = F.length(F.regexp_extract(k, "^(\x7f*)", 1))
    c = F.substr(k, top + 1, F.lit(1))
    return F.when(top < F.length(k), F.concat(F.substr(k, F.lit(1), top), F.char(F.ascii(c) + 1))).otherwise(k)


def parse_file_name(name: Column) -> tuple[Column, Column]:
    """(kind, number) of a store's file name; kind is null if it isn't one. CURRENT and the others without a number have 0."""
    number = F.regexp_extract(name, r"([0-9]+)", 1)
    kind = (
        F.when(name == "CURRENT", "current").when(name == "LOCK", "lock").when(name.isin("LOG", "LOG.old"), "info")
        .when(name.rlike(r"^MANIFEST-[0-9]+$"), "manifest").when(name.rlike(r"^[0-9]+\.log$"), "log")
        .when(name.rlike(r"^[0-9]+\.(ldb|sst)$"), "table").when(name.rlike(r"^[0-9]+\.dbtmp$"), "temp")
    )
    return kind, F.when(kind.isNotNull(), F.when(number == "", F.lit(0).cast("bigint")).otherwise(number.try_cast("bigint")))


def level_capacity(level: Column) -> Column:
    """Bytes that a level from 1 on should hold."""
    return F.lit(10485760.0) * F.pow(F.lit(10.0), level - 1)
