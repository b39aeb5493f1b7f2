"""Sequence expressions: everything here is a Catalyst expression and stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two-bit base codes, and each base's complement.
CODE_ORDER = "ACTG"
BASES, COMPLEMENTS = "ACGT", "TGCA"
PHRED_OFFSET = 33
#: Bases that one LONG holds.
PACKED_K = 31


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_base(base: Column | str) -> Column:
    """The two-bit code of a base in either case; null if it is none."""
    at = F.instr(F.lit(CODE_ORDER), F.upper(_col(base)))
    return F.when((F.length(_col(base)) == 1) & (at > 0), at - 1)


def decode_base(code: Column | str) -> Column:
    return F.when(_col(code).between(0, 3), F.substring(F.lit(CODE_ORDER), _col(code) + 1, 1))


def complement_code(code: Column | str) -> Column:
    return _col(code).bitwiseXOR(F.lit(2))


def complement_base(base: Column | str) -> Column:
    return F.translate(F.upper(_col(base)), BASES, COMPLEMENTS)


def is_base(base: Column | str) -> Column:
    return F.upper(_col(base)).rlike("^[ACGT]$")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement_base(seq))


def canonical(seq: Column | str) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(F.upper(_col(seq)), reverse_complement(seq))


def prefix(seq: Column | str, k: int) -> Column:
    """The first k-1 bases of a k-mer."""
    return F.substring(_col(seq), 1, k - 1)


def suffix(seq: Column | str, k: int) -> Column:
    """The last k-1 bases of a k-mer."""
    return F.right(_col(seq), F.lit(k - 1))


def phred(char: Column | str) -> Column:
    """The quality a PHRED+33 character stands for, at least 0."""
    return F.greatest(F.ascii(_col(char)) - PHRED_OFFSET, F.lit(0))


def endpoint_byte(kmer: Column | str) -> Column:
    """First base's code in bits 3-2, last base's in bits 1-0."""
    return encode_base(F.left(_col(kmer), F.lit(1))) * 4 + encode_base(F.right(_col(kmer), F.lit(1)))


def packed(kmer: Column | str) -> Column:
    """A k-mer of at most 31 bases as one LONG, first base in the high bits, in the order of `CODE_ORDER`."""
    return F.conv(F.translate(F.upper(_col(kmer)), CODE_ORDER, "0123"), 4, 10).cast("long")


def unpacked(word: Column | str, k: int, order: str = CODE_ORDER) -> Column:
    return F.translate(F.lpad(F.conv(_col(word).cast("string"), 10, 4), k, "0"), "0123", order)


def packed_base(word: Column | str, i: int, k: int) -> Column:
    """The code of base ``i`` (from 0) of a packed k-mer."""
    return F.shiftright(_col(word), 2 * (k - 1 - i)).bitwiseAND(F.lit(3))


def packed_bits(k: int) -> int:
    """Bits of the narrowest word that holds k bases two bits each: 64, 128, 256 or 512."""
    return next(w for w in (64, 128, 256, 512) if 2 * k <= w)


def path_signature(path: Column | str) -> Column:
    """The lesser of a path and its reverse, so that both directions have one signature."""
    return F.least(_col(path), F.reverse(_col(path)))


def oriented(path: Column | str, orient: Column | str) -> Column:
    """A node's k-mers as read in the orientation '+' or '-'."""
    return F.when(_col(orient) == "+", _col(path)).otherwise(F.transform(F.reverse(_col(path)), reverse_complement))


def flip(orient: Column | str) -> Column:
    return F.when(_col(orient) == "+", "-").otherwise("+")


def shard_of(kmer: Column | str, shards: int) -> Column:
    return F.pmod(F.xxhash64(_col(kmer)), F.lit(shards))
